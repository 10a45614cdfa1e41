"""Normalization, selection, propagation and traversal over the derived graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spindrift.operators import blocks
from spindrift.operators import graph as g
from spindrift.operators import metrics as m
from spindrift.operators import normalize as nz
from spindrift.operators import offsets
from spindrift.operators import populations as pop
from spindrift.operators import storage
from spindrift.queries import views as v

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: v.longs(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


W = v.with_


@query(W("ann") + "SELECT row_number() OVER (ORDER BY body_id) - 1 AS neuron_index, body_id FROM ann WHERE superclass IS NOT NULL")
def norm_neuron_map(s, d):
    return nz.neuron_map(v.annotations(s, d)).select("neuron_index", "body_id")


@query(W("neurons") + "SELECT neuron_index, body_id, superclass, type, side AS root_side, consensus_nt, ground_truth_nt FROM neurons")
def norm_neurons(s, d):
    return nz.neurons(nz.check_columns(v.annotations(s, d), "annotations"), nz.check_columns(v.transmitters(s, d), "neurotransmitters")).select("neuron_index", "body_id", "superclass", "type", "root_side", "consensus_nt", "ground_truth_nt")


@query(W("edges") + "SELECT source_index, target_index, synapse_count FROM edges")
def norm_edges(s, d):
    return nz.checked_edges(v.edges(s, d))


@query(W("edges") + """SELECT (SELECT count(*) FROM neurons) AS neuron_count, (SELECT count(*) FROM neurons WHERE consensus_nt IS NULL) AS neurons_without_consensus_nt, count(*) AS edge_count, sum(synapse_count)::BIGINT AS synaptic_contact_count,
count(*) FILTER (source_index = target_index) AS self_edge_count, (SELECT count(*) FROM ann WHERE superclass IS NULL) AS excluded_annotation_rows, (SELECT count(*) FROM raw) - count(*) AS excluded_connectivity_rows FROM edges""")
def norm_report(s, d):
    return nz.report(v.annotations(s, d), v.connectivity(s, d), v.neurons(s, d), v.edges(s, d))


@query(W("edges") + "SELECT (count(*) - count(DISTINCT (source_index, target_index)))::BIGINT AS duplicate_pairs, count(*) FILTER (synapse_count NOT BETWEEN 1 AND 2147483647) AS bad_weights FROM edges")
def edge_order_check(s, d):
    return nz.edge_order_violations(v.edges(s, d))


@query("SELECT count(*) AS rows, count(*) FILTER (p_partkey IS NULL) AS null_ids, count(p_partkey) - count(DISTINCT p_partkey) AS duplicate_ids FROM part")
def source_id_check(s, d):
    return nz.check_unique_ids(v.annotations(s, d), "bodyId")


def _offsets_sql(by: str) -> str:
    return W("edges") + f"SELECT neuron_index AS node, count({by}) AS degree, coalesce(sum(count({by})) OVER (ORDER BY neuron_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM neurons LEFT JOIN edges ON neuron_index = {by} GROUP BY neuron_index"


@query(_offsets_sql("target_index"))
def csr_offsets_in(s, d):
    return nz.offsets(v.edges(s, d), v.neurons(s, d))


@query(_offsets_sql("source_index"))
def csr_offsets_out(s, d):
    return nz.offsets(v.edges(s, d), v.neurons(s, d), "source_index")


def _sorted(s, d, order):
    """Offsets of every node, out of files that were sorted, checked and written with offsets beside them."""
    path = f"{storage.shared_dir(s)}/sorted-{uuid.uuid4().hex}"
    offsets.write(v.edges(s, d), path, order, partitions=7)
    return offsets.dense(s.read.parquet(f"{path}/offsets"), v.neurons(s, d))


@query(_offsets_sql("target_index"))
def sorted_offsets_in(s, d):
    return _sorted(s, d, offsets.IN)


@query(_offsets_sql("source_index"))
def sorted_offsets_out(s, d):
    return _sorted(s, d, offsets.OUT)


@query(W("edges") + "SELECT 0 AS inside, 0 AS borders, count(*) AS rows FROM edges")
def order_faults(s, d):
    path = f"{storage.shared_dir(s)}/sorted-{uuid.uuid4().hex}"
    storage.write_sorted(v.edges(s, d), path, *offsets.IN, partitions=7)
    return offsets.order_faults(s.read.parquet(path))


def _buckets(s, d):
    name = f"graph_{uuid.uuid4().hex}"
    offsets.write_buckets(v.neurons(s, d), v.edges(s, d), name, 8, f"{storage.shared_dir(s)}/{name}")
    return offsets.Buckets(s, name)


@query(W("edges") + "SELECT n.neuron_index, coalesce(i.n, 0) AS in_degree, coalesce(i.c, 0)::BIGINT AS in_contacts, coalesce(o.n, 0) AS out_degree, coalesce(o.c, 0)::BIGINT AS out_contacts FROM neurons n LEFT JOIN (SELECT target_index k, count(*) n, sum(synapse_count) c FROM edges GROUP BY 1) i ON i.k = neuron_index LEFT JOIN (SELECT source_index k, count(*) n, sum(synapse_count) c FROM edges GROUP BY 1) o ON o.k = neuron_index")
def bucket_degrees(s, d):
    """Joins of both orientations and the nodes, bucket by bucket."""
    return _buckets(s, d).degrees()


@query(W("edges") + "SELECT i.k AS neuron_index, i.n * o.n AS paths FROM (SELECT target_index k, count(*) n FROM edges GROUP BY 1) i JOIN (SELECT source_index k, count(*) n FROM edges GROUP BY 1) o ON i.k = o.k")
def bucket_through(s, d):
    return _buckets(s, d).through()


@query(W("edges") + "SELECT coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, count(*) AS nodes FROM neurons LEFT JOIN (SELECT target_index k, count(*) n FROM edges GROUP BY 1) i ON i.k = neuron_index LEFT JOIN (SELECT source_index k, count(*) n FROM edges GROUP BY 1) o ON o.k = neuron_index GROUP BY 1, 2")
def degree_histogram(s, d):
    e = v.edges(s, d)
    i = e.groupBy(F.col("target_index").alias("neuron_index")).agg(F.count("*").alias("in_degree"))
    o = e.groupBy(F.col("source_index").alias("neuron_index")).agg(F.count("*").alias("out_degree"))
    n = v.neurons(s, d).select("neuron_index").join(i, "neuron_index", "left").join(o, "neuron_index", "left").fillna(0)
    return n.groupBy("in_degree", "out_degree").agg(F.count("*").alias("nodes"))


def _orientations(s, d, lost: str = "false"):
    """Both orientations as tables written apart; edges that lost names are missing from the outgoing one."""
    e = storage.materialize(v.edges(s, d), "edges")
    into = storage.materialize(e.repartitionByRange("target_index", "source_index").sortWithinPartitions("target_index", "source_index"), "incoming")
    out = storage.materialize(e.where(f"not ({lost})").repartitionByRange("source_index", "target_index").sortWithinPartitions("source_index", "target_index"), "outgoing")
    return into, out


@query(W("edges") + "SELECT count(*) AS in_edges, count(*) AS out_edges, sum(synapse_count)::BIGINT AS in_contacts, sum(synapse_count)::BIGINT AS out_contacts, 0::BIGINT AS edges_apart, 0::BIGINT AS nodes_apart FROM edges")
def degree_validation(s, d):
    return nz.orientation_check(*_orientations(s, d))


@query(W("edges") + "SELECT count(*) AS in_edges, count(*) FILTER (NOT x) AS out_edges, sum(synapse_count)::BIGINT AS in_contacts, (sum(synapse_count) FILTER (NOT x))::BIGINT AS out_contacts, count(*) FILTER (x) AS edges_apart, count(DISTINCT source_index) FILTER (x) AS nodes_apart FROM (SELECT *, (source_index + target_index) % 97 = 0 AS x FROM edges)")
def degree_validation_fault(s, d):
    """The same check over an outgoing table that lacks some edges."""
    return nz.orientation_check(*_orientations(s, d, "(source_index + target_index) % 97 = 0"))


@query(W("neurons") + "SELECT coalesce(lower(coalesce(ground_truth_nt, consensus_nt)), 'missing') AS transmitter, count(*) AS n FROM neurons GROUP BY 1")
def transmitter_counts(s, d):
    return v.neurons(s, d).groupBy(F.coalesce(F.lower(g.effective_transmitter()), F.lit("missing")).alias("transmitter")).agg(F.count("*").alias("n"))


@query(W("neurons") + "SELECT sign, count(*) AS n, min(neuron_index) AS first_member, max(neuron_index) AS last_member FROM neurons GROUP BY sign")
def sign_counts(s, d):
    return pop.by_sign(v.neurons(s, d))


@query(W("neurons") + "SELECT CASE lower(coalesce(ground_truth_nt, consensus_nt)) WHEN 'acetylcholine' THEN 1 WHEN 'gaba' THEN -1 WHEN 'glutamate' THEN 1 ELSE 0 END AS sign, count(*) AS n FROM neurons GROUP BY 1")
def sign_policy_excitatory(s, d):
    return g.with_sign(v.neurons(s, d), g.GLUTAMATE_EXCITES).groupBy("sign").agg(F.count("*").alias("n"))


@query(W("neurons") + "SELECT superclass AS value, count(*) AS n FROM neurons WHERE superclass <> '' GROUP BY 1")
def superclass_counts(s, d):
    return nz.string_counts(v.neurons(s, d), "superclass")


@query(W("neurons") + "SELECT neuron_index FROM neurons WHERE superclass = 'ECONOMY' AND side = 'L'")
def catalog_select(s, d):
    return g.select(v.neurons(s, d), superclass="ECONOMY", root_side="L")


@query(W("neurons") + "SELECT r.position, r.i AS neuron_index, body_id FROM (VALUES (0, 7), (1, 3), (2, 11)) r(position, i) JOIN neurons ON i = neuron_index")
def catalog_take(s, d):
    return g.take(v.neurons(s, d), [7, 3, 11])


_SPECS = [("economy", "ECONOMY", None, 5), ("left", None, "L", 4), ("standard_right", "STANDARD", "R", None)]


@query(W("neurons") + ", specs(key, superclass, side, k) AS (VALUES ('economy', 'ECONOMY', NULL, 5), ('left', NULL, 'L', 4), ('standard_right', 'STANDARD', 'R', NULL)) SELECT key, row_number() OVER w AS rank, neuron_index, body_id, count(*) OVER (PARTITION BY key) AS available FROM neurons n JOIN specs p ON (p.superclass IS NULL OR p.superclass = n.superclass) AND (p.side IS NULL OR p.side = n.side) WINDOW w AS (PARTITION BY key ORDER BY body_id) QUALIFY k IS NULL OR rank <= k")
def population_sample(s, d):
    specs = s.createDataFrame(_SPECS, "key string, superclass string, root_side string, sample_limit int")
    return pop.resolve(v.neurons(s, d), specs, ["superclass", "root_side"])


@query(W("neurons") + "SELECT neuron_index FROM neurons WHERE superclass = 'ECONOMY' UNION SELECT neuron_index FROM neurons WHERE sign = 1")
def population_union(s, d):
    n = v.neurons(s, d)
    return pop.union(g.select(n, superclass="ECONOMY"), n.where("sign = 1").select("neuron_index"))


@query(W("neurons") + "SELECT neuron_index FROM neurons WHERE superclass = 'ECONOMY' INTERSECT SELECT neuron_index FROM neurons WHERE sign = 1")
def population_intersection(s, d):
    n = v.neurons(s, d)
    return g.select(n, superclass="ECONOMY").intersect(n.where("sign = 1").select("neuron_index"))


@query(W("neurons") + "SELECT neuron_index FROM neurons WHERE superclass = 'ECONOMY' EXCEPT SELECT neuron_index FROM neurons WHERE sign = 1")
def population_difference(s, d):
    n = v.neurons(s, d)
    return g.select(n, superclass="ECONOMY").join(n.where("sign = 1"), "neuron_index", "left_anti")


@query("WITH i(k) AS (VALUES ('a'), ('b')), a(x) AS (VALUES (2.0), (8.5)), m(y) AS (VALUES (50.0)), r(z) AS (VALUES (0), (1)) SELECT k || '-a' || CASE x WHEN 2.0 THEN '2' ELSE '8.5' END || '-d50ms-r' || z AS condition_id, k AS input_key, x::DOUBLE AS amplitude, y::DOUBLE AS duration_ms, z AS repeat FROM i, a, m, r UNION ALL SELECT 'control-r' || z, NULL, 0.0, 0.0, z FROM r")
def condition_matrix(s, d):
    return pop.cross_conditions(s.createDataFrame([("a",), ("b",)], "key string"), [2.0, 8.5], [50.0], 2)


@query(W("edges") + "SELECT n.neuron_index, coalesce(o, 0.0)::DOUBLE AS output FROM neurons n LEFT JOIN (SELECT target_index AS k, sum(synapse_count * sign * (source_index % 3))::DOUBLE AS o FROM edges JOIN neurons ON source_index = neuron_index GROUP BY 1) ON k = n.neuron_index")
def propagate_dense(s, d):
    n = v.neurons(s, d)
    return g.propagate(n, v.edges(s, d), n.select(F.col("neuron_index").alias("source_index"), (F.col("neuron_index") % 3).cast("double").alias("activity")))


@query(W("edges") + "SELECT target_index, sum(synapse_count * sign * 0.5)::DOUBLE AS amount, count(*) AS visited FROM edges JOIN neurons ON source_index = neuron_index WHERE sign <> 0 AND source_index % 20 = 0 GROUP BY 1")
def accumulate_events(s, d):
    n = v.neurons(s, d)
    return g.accumulate(n, v.edges(s, d), n.where("neuron_index % 20 = 0").select(F.col("neuron_index").alias("source_index"), F.lit(0.5).alias("activity")))


@query(W("edges") + "SELECT target_index, sum(synapse_count * sign)::BIGINT AS weight, count(*) AS edge_count FROM edges JOIN neurons ON source_index = neuron_index WHERE sign <> 0 AND source_index % 20 = 0 GROUP BY 1 HAVING sum(synapse_count * sign) <> 0")
def project_sources(s, d):
    n = v.neurons(s, d)
    return g.project(n, v.edges(s, d), n.where("neuron_index % 20 = 0").select(F.col("neuron_index").alias("source_index")))


def _blocks(s, d):
    return storage.materialize(blocks.pack(v.edges(s, d)), "blocks")


@query(ORACLE["propagate_dense"])
def propagate_blocked(s, d):
    """propagate_dense on compressed blocks: no row for an edge."""
    n = v.neurons(s, d)
    return blocks.propagate(n, _blocks(s, d), n.select(F.col("neuron_index").alias("source_index"), (F.col("neuron_index") % 3).cast("double").alias("activity")))


@query(ORACLE["accumulate_events"])
def accumulate_blocked(s, d):
    n = v.neurons(s, d)
    return blocks.accumulate(n, _blocks(s, d), n.where("neuron_index % 20 = 0").select(F.col("neuron_index").alias("source_index"), F.lit(0.5).alias("activity")))


@query(W("edges") + "SELECT source_index, target_index, synapse_count FROM edges")
def blocked_edges(s, d):
    return blocks.unpack(_blocks(s, d))


@query(W("edges") + "SELECT least(source_index, target_index) AS source_index, greatest(source_index, target_index) AS target_index, sum(CASE WHEN source_index < target_index THEN synapse_count ELSE -synapse_count END)::BIGINT AS weight FROM edges WHERE source_index <> target_index GROUP BY 1, 2 HAVING sum(CASE WHEN source_index < target_index THEN synapse_count ELSE -synapse_count END) <> 0")
def combine_duplicates(s, d):
    e = v.edges(s, d).where("source_index <> target_index")
    return g.combine_duplicates(e.select(F.least("source_index", "target_index").alias("source_index"), F.greatest("source_index", "target_index").alias("target_index"), F.when(F.col("source_index") < F.col("target_index"), F.col("synapse_count")).otherwise(-F.col("synapse_count")).alias("weight")))


@query(W("edges") + ", m AS (SELECT neuron_index, row_number() OVER (ORDER BY neuron_index) - 1 AS local FROM neurons WHERE neuron_index % 5 = 0) SELECT a.local AS local_source, b.local AS local_target, synapse_count, source_index, target_index FROM edges JOIN m a ON source_index = a.neuron_index JOIN m b ON target_index = b.neuron_index")
def induced_subgraph(s, d):
    return g.induced(v.edges(s, d), v.neurons(s, d).where("neuron_index % 5 = 0"))


@query(W("edges") + "SELECT source_index, synapse_count FROM edges WHERE target_index = 17")
def incoming_edges(s, d):
    return g.incoming(v.edges(s, d), 17)


@query(W("edges") + "SELECT target_index, synapse_count FROM edges WHERE source_index = 17")
def outgoing_edges(s, d):
    return g.outgoing(v.edges(s, d), 17)


@query(W("edges") + "SELECT target_index, sum(synapse_count)::BIGINT AS contacts, count(*) AS sources FROM edges JOIN neurons t ON target_index = t.neuron_index WHERE source_index % 20 = 0 AND t.type = 'Brand#12' GROUP BY 1")
def direct_targets(s, d):
    e = v.edges(s, d).where("source_index % 20 = 0")
    wanted = v.neurons(s, d).where("type = 'Brand#12'").select(F.col("neuron_index").alias("target_index"))
    return e.join(wanted, "target_index").groupBy("target_index").agg(F.sum("synapse_count").alias("contacts"), F.count("*").alias("sources"))


@query(W("edges") + "SELECT count(*) AS edges, sum(synapse_count)::BIGINT AS contacts, count(DISTINCT target_index) AS targets, count(DISTINCT coalesce(ground_truth_nt, consensus_nt)) AS transmitters FROM edges JOIN neurons ON source_index = neuron_index WHERE superclass = 'ECONOMY'")
def outgoing_summary(s, d):
    n = v.neurons(s, d).where("superclass = 'ECONOMY'").select(F.col("neuron_index").alias("source_index"), g.effective_transmitter().alias("nt"))
    return v.edges(s, d).join(n, "source_index").agg(F.count("*").alias("edges"), F.sum("synapse_count").alias("contacts"), F.count_distinct("target_index").alias("targets"), F.count_distinct("nt").alias("transmitters"))


_INFER = """, r AS (SELECT *, row_number() OVER w AS rk, lead(contacts, 1, 0) OVER w AS second, sum(contacts) OVER (PARTITION BY source)::BIGINT AS total, count(*) OVER (PARTITION BY source) AS candidates FROM contacts WINDOW w AS (PARTITION BY source ORDER BY contacts DESC, "column")),
inferred AS (SELECT source, CASE WHEN total < 12 THEN 'unmapped' WHEN candidates = 1 THEN 'unique' WHEN contacts / total::DOUBLE >= 0.16 THEN 'dominant' WHEN contacts / total::DOUBLE >= 0.1 THEN 'low' ELSE 'ambiguous' END AS status, "column" AS c, contacts, total, candidates, contacts / total::DOUBLE AS fraction, (contacts - second) / total::DOUBLE AS margin FROM r WHERE rk = 1)"""


@query(W("contacts") + _INFER + 'SELECT source, status, CASE WHEN status IN (\'unique\', \'dominant\', \'low\') THEN c END AS "column", contacts, total, candidates, round(fraction, 6) AS fraction, round(margin, 6) AS margin FROM inferred')
def column_inference(s, d):
    return m.infer_columns(v.contacts(s, d), 12, 0.16, 0.1).withColumns({"fraction": F.round("fraction", 6), "margin": F.round("margin", 6)})


@query(W("contacts") + _INFER + "SELECT status, count(*) AS n, round(quantile_cont(total::DOUBLE, 0.05), 6) AS p05, round(quantile_cont(total::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(total::DOUBLE, 0.95), 6) AS p95 FROM inferred GROUP BY 1")
def column_summary(s, d):
    i = m.infer_columns(v.contacts(s, d), 12, 0.16, 0.1)
    return i.groupBy("status").agg(F.count("*").alias("n"), *[F.round(F.percentile("total", p), 6).alias(name) for p, name in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))])


_WALK = """, usable AS (SELECT source_index, target_index FROM edges JOIN neurons ON source_index = neuron_index WHERE sign <> 0),
h0 AS (SELECT DISTINCT neuron_index AS node, 0 AS distance FROM neurons WHERE {first}),
h1 AS (SELECT {to} AS node, 1 AS distance FROM usable JOIN h0 ON {at} = node), d1 AS (SELECT node, min(distance) AS distance FROM (FROM h0 UNION ALL FROM h1) GROUP BY node),
h2 AS (SELECT {to} AS node, 2 AS distance FROM usable JOIN d1 ON {at} = node AND d1.distance = 1), d2 AS (SELECT node, min(distance) AS distance FROM (FROM d1 UNION ALL FROM h2) GROUP BY node)"""


def _walk(first: str, forward: bool) -> str:
    return _WALK.format(first=first, at="source_index" if forward else "target_index", to="target_index" if forward else "source_index")


@query(W("edges") + _walk("neuron_index < 3", True) + " SELECT node, distance FROM d2")
def bfs_forward(s, d):
    n = v.neurons(s, d)
    return g.distances(n, v.edges(s, d), n.where("neuron_index < 3"), 2)


@query(W("edges") + _walk("neuron_index BETWEEN 10 AND 12", False) + " SELECT node, distance FROM d2")
def bfs_reverse(s, d):
    n = v.neurons(s, d)
    return g.distances(n, v.edges(s, d), n.where("neuron_index between 10 and 12"), 2, forward=False)


_LAYERS = _walk("neuron_index < 3", True) + """, t AS (SELECT neuron_index AS target FROM neurons WHERE neuron_index BETWEEN 500 AND 540), len AS (SELECT target, distance AS length FROM t JOIN d2 ON target = node),
b0 AS (SELECT target, target AS node, 0 AS distance FROM t), b1 AS (SELECT DISTINCT b0.target, source_index AS node, 1 AS distance FROM b0 JOIN usable ON target_index = node), e1 AS (SELECT target, node, min(distance) AS distance FROM (FROM b0 UNION ALL FROM b1) GROUP BY 1, 2),
b2 AS (SELECT DISTINCT target, source_index AS node, 2 AS distance FROM e1 JOIN usable ON target_index = node WHERE distance = 1), e2 AS (SELECT target, node, min(distance) AS distance FROM (FROM e1 UNION ALL FROM b2) GROUP BY 1, 2),
layers AS (SELECT len.target, length, d2.distance AS layer, d2.node FROM len JOIN e2 ON e2.target = len.target JOIN d2 ON d2.node = e2.node WHERE d2.distance + e2.distance = length),
between_ AS (SELECT a.target, a.layer AS hop, source_index, target_index, synapse_count, sign FROM edges JOIN layers a ON a.node = source_index JOIN layers b ON b.node = target_index AND b.target = a.target AND b.layer = a.layer + 1 JOIN neurons ON neuron_index = source_index WHERE sign <> 0)"""


def _written(s, d):
    """The graph's two tables, written once for searches that read them several times."""
    return storage.materialize(v.neurons(s, d), "neurons"), storage.materialize(v.edges(s, d), "edges")


def _layers(s, d):
    n, e = _written(s, d)
    return n, e, g.path_layers(n, e, n.where("neuron_index < 3"), n.where("neuron_index between 500 and 540"), 2)


@query(W("edges") + _LAYERS + " SELECT target, length, layer, node FROM layers")
def path_layers(s, d):
    return _layers(s, d)[2]


@query(W("edges") + _LAYERS + " SELECT target, hop, source_index, target_index, synapse_count, sign FROM between_")
def path_layer_edges(s, d):
    return g.layer_edges(*_layers(s, d))


@query(W("edges") + _LAYERS + """, walks AS (SELECT target, ln(1 + synapse_count) AS score, [source_index, target_index] AS nodes, [synapse_count] AS contacts FROM between_ WHERE hop = 0 AND target_index = target
UNION ALL SELECT a.target, ln(1 + a.synapse_count) + ln(1 + b.synapse_count), [a.source_index, a.target_index, b.target_index], [a.synapse_count, b.synapse_count] FROM between_ a JOIN between_ b ON a.target = b.target AND a.hop = 0 AND b.hop = 1 AND a.target_index = b.source_index AND b.target_index = a.target
UNION ALL SELECT target, 0.0, [node], [] FROM layers WHERE layer = 0 AND node = target)
SELECT target, row_number() OVER w AS rank, round(score, 6) AS score, array_to_string(nodes, '>') AS nodes, array_to_string(contacts, ',') AS contacts FROM walks WINDOW w AS (PARTITION BY target ORDER BY round(score, 9) DESC, nodes DESC, contacts DESC) QUALIFY rank <= 3""")
def top_paths(s, d):
    n, e, layers = _layers(s, d)
    between = g.layer_edges(n, e, layers)
    return g.ranked_paths(layers, between, 3, 2).select("target", "rank", F.round("score", 6).alias("score"), F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), F.array_join(F.col("contacts").cast("array<string>"), ",").alias("contacts"))


@query(W("edges", recursive=True) + ", up(target, node, distance) AS (SELECT neuron_index, neuron_index, 0 FROM neurons WHERE neuron_index % 20 = 0 UNION SELECT target, source_index, distance + 1 FROM up JOIN edges ON target_index = node JOIN neurons n ON n.neuron_index = source_index WHERE n.sign <> 0 AND distance < 2) SELECT target, node, min(distance) AS distance FROM up GROUP BY 1, 2")
def reverse_from_all(s, d):
    """Reverse search from a twentieth of all neurons at once, 64 of them to a number."""
    n, e = _written(s, d)
    return g.expanded(*g.reverse_bits(n, e, n.where("neuron_index % 20 = 0"), 2)).select("target", "node", "distance")


@query(W("trade") + "SELECT source_index, target_index, synapse_count, row_number() OVER (PARTITION BY source_index ORDER BY synapse_count DESC, target_index) AS rank FROM trade WHERE source_index IN (1, 4, 9) QUALIFY rank <= 6")
def neighborhood_candidates(s, d):
    return g.neighborhood_candidates(v.trade(s, d), s.createDataFrame([(1,), (4,), (9,)], "neuron_index int"), 6).select("source_index", "target_index", "synapse_count", "rank")


@query(W("trade", recursive=True) + """, c AS (SELECT source_index, target_index, synapse_count, row_number() OVER (ORDER BY synapse_count DESC, source_index, target_index) AS i FROM (SELECT *, row_number() OVER (PARTITION BY source_index ORDER BY synapse_count DESC, target_index) AS rank FROM trade WHERE source_index IN (1, 4, 9)) WHERE rank <= 20),
g AS (SELECT 0::BIGINT AS i, [1, 4, 9]::BIGINT[] AS nodes, 0::BIGINT AS kept, false AS keep UNION ALL SELECT i, CASE WHEN ok THEN more ELSE nodes END, kept + ok::BIGINT, ok FROM (SELECT *, kept < 20 AND len(more) <= 8 AS ok FROM (SELECT c.i, nodes, kept, list_distinct(nodes || [source_index::BIGINT, target_index::BIGINT]) AS more FROM g JOIN c ON c.i = g.i + 1)))
SELECT source_index, target_index, synapse_count FROM g JOIN c USING (i) WHERE keep""")
def neighborhood(s, d):
    return g.neighborhood(v.trade(s, d).select("source_index", "target_index", "synapse_count"), [1, 4, 9], max_nodes=8, max_edges=20)


@query(W("trade") + ", strong AS (SELECT source_index, max(synapse_count) AS best FROM trade WHERE source_index <> target_index AND sign = 1 GROUP BY 1 ORDER BY best DESC, source_index LIMIT 2), near AS (SELECT source_index AS seed, row_number() OVER (PARTITION BY source_index ORDER BY synapse_count DESC, target_index) AS rank, target_index AS member FROM trade SEMI JOIN strong USING (source_index) WHERE source_index <> target_index QUALIFY rank < 5) SELECT * FROM near UNION ALL SELECT source_index, 0, source_index FROM strong")
def strong_neighborhoods(s, d):
    e = v.trade(s, d)
    return g.strong_neighborhoods(e, e.where("sign = 1").select(F.col("source_index").alias("neuron_index")).distinct(), 2, 5)


@query(W("trade") + "SELECT target_index, sum(abs(synapse_count * sign))::BIGINT AS weight FROM trade WHERE target_index NOT IN (0, 1) GROUP BY 1 ORDER BY weight DESC, target_index LIMIT 7")
def top_downstream(s, d):
    return v.trade(s, d).where(~F.col("target_index").isin(0, 1)).groupBy("target_index").agg(F.sum(F.abs(F.col("synapse_count") * F.col("sign"))).alias("weight")).orderBy(F.desc("weight"), "target_index").limit(7)


@query(W("trade") + "SELECT CASE WHEN grouping(t) = 0 THEN t END AS type, CASE WHEN grouping(c) = 0 THEN c END AS category, count(*) AS edges, sum(n)::BIGINT AS contacts, sum(n * sign)::BIGINT AS signed, coalesce(sum(n) FILTER (sign > 0), 0)::BIGINT AS excitatory, coalesce(sum(n) FILTER (sign < 0), 0)::BIGINT AS inhibitory FROM (SELECT synapse_count AS n, sign, n_name AS t, 'region' || n_regionkey AS c FROM trade JOIN nation ON n_nationkey = target_index) GROUP BY GROUPING SETS ((t), (c), ())")
def edge_group_summary(s, d):
    n = v.read(s, d, "nation").select(F.col("n_nationkey").alias("target_index"), F.col("n_name").alias("type"), F.concat(F.lit("region"), "n_regionkey").alias("category"))
    return m.edge_groups(v.trade(s, d).withColumnRenamed("synapse_count", "count").join(F.broadcast(n), "target_index"))  # 25 nations


@query(W("neurons") + "SELECT type AS family, sum(sign) FILTER (side = 'L')::BIGINT AS \"left\", sum(sign) FILTER (side = 'R')::BIGINT AS \"right\", (sum(sign) FILTER (side = 'R') - sum(sign) FILTER (side = 'L'))::BIGINT AS difference FROM neurons GROUP BY type HAVING count(*) FILTER (side = 'L') > 0 AND count(*) FILTER (side = 'R') > 0")
def lr_asymmetry(s, d):
    from spindrift.functions.scalars import family_side

    return m.paired_asymmetry(v.neurons(s, d).select(*family_side(F.col("instance")), F.col("sign").cast("long").alias("sign")), "family", "side", "sign")


@query(W("neurons") + "SELECT type AS label, count(*) AS members FROM neurons WHERE sign = 1 GROUP BY type HAVING count(*) >= 20")
def annotation_groups(s, d):
    return v.neurons(s, d).where("sign = 1").groupBy(F.col("type").alias("label")).agg(F.count("*").alias("members")).where("members >= 20")


@query(W("neurons") + "SELECT n.neuron_index, coalesce(body_id % 7 = 0, false) AS in_atlas, CASE WHEN body_id % 7 = 0 AND body_id % 5 < 3 THEN body_id // 7 END AS visible_row, CASE WHEN body_id % 7 <> 0 THEN 'no soma' WHEN body_id % 5 >= 3 THEN 'hidden group' END AS reason FROM neurons n")
def atlas_join(s, d):
    atlas = v.read(s, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("body_id"), (F.col("p_partkey") / 7).cast("long").alias("atlas_row"), (F.col("p_partkey") % 5).alias("atlas_group"))
    j = v.neurons(s, d).select("neuron_index", "body_id").join(atlas, "body_id", "left")
    return j.select("neuron_index", F.col("atlas_row").isNotNull().alias("in_atlas"), F.when(F.col("atlas_group") < 3, F.col("atlas_row")).alias("visible_row"), F.when(F.col("atlas_row").isNull(), "no soma").when(F.col("atlas_group") >= 3, "hidden group").alias("reason"))


@query(W("neurons") + "SELECT count(*) FILTER (n.body_id IS NULL) AS missing, count(*) FILTER (type <> s.s_name) AS type_mismatch, count(*) AS listed FROM supplier s LEFT JOIN neurons n ON n.body_id = s.s_suppkey")
def source_consistency(s, d):
    listed = v.read(s, d, "supplier").select(F.col("s_suppkey").alias("body_id"), "s_name")
    j = listed.join(v.neurons(s, d).select("body_id", "type", F.lit(1).alias("known")), "body_id", "left")
    return j.agg(F.count_if(F.col("known").isNull()).alias("missing"), F.count_if(F.col("type") != F.col("s_name")).alias("type_mismatch"), F.count("*").alias("listed"))


@query(W("edges", recursive=True) + ", up(node, hop) AS (SELECT 500::BIGINT, 0 UNION SELECT source_index, hop + 1 FROM up JOIN edges ON target_index = node WHERE hop < 8) SELECT min(hop) AS hop FROM up WHERE hop >= 1 AND node < 3")
def upstream_hop(s, d):
    n, e = _written(s, d)
    hop = g.upstream_hop(e, n.where("neuron_index < 3"), n.where("neuron_index = 500"))
    return s.createDataFrame([(hop,)], "hop int")


@query(W("edges") + "SELECT count(*) AS rows, sum(('0x' || substr(md5(source_index || '|' || synapse_count || '|' || target_index), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS content FROM edges")
def content_lock(s, d):
    return nz.content_lock(v.edges(s, d))
