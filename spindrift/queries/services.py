"""Panel answers over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import scalars as sc
from spindrift.operators import graph
from spindrift.plans import service
from spindrift.plans.dataset import Dataset
from spindrift.queries import graphs
from spindrift.queries import views as v

QUERIES, ORACLE = {}, {}
W = v.with_


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: v.longs(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _atlas(s, d):
    return v.read(s, d, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("body_id"), F.floor(F.col("p_partkey") / 7).alias("atlas_row"), (F.col("p_partkey") % 5).alias("atlas_group"))


def _data(s, d):
    return Dataset(v.neurons(s, d), v.edges(s, d))


@query(W("edges") + "SELECT count(*) AS neurons, count(*) FILTER (body_id % 7 = 0) AS with_soma, count(*) FILTER (body_id % 7 = 0 AND body_id % 5 < 3) AS visible, (SELECT count(*) FROM edges) AS edges FROM neurons")
def panel_status(s, d):
    return service.status(_data(s, d), _atlas(s, d))


@query(W("neurons") + "SELECT position, i AS neuron_index, body_id::VARCHAR AS body_id, CASE WHEN body_id % 7 = 0 AND body_id % 5 < 3 THEN body_id // 7 END AS atlas_row, CASE WHEN body_id % 7 <> 0 THEN 'no soma' WHEN body_id % 5 >= 3 THEN 'hidden group' END AS reason FROM (VALUES (0, 40), (1, 5), (2, 11), (3, 12)) q(position, i) JOIN neurons ON i = neuron_index")
def panel_map(s, d):
    return service.map_indices(_data(s, d), _atlas(s, d), [40, 5, 11, 12])


@query(W("edges") + "SELECT type, row_number() OVER (PARTITION BY type ORDER BY contacts DESC, target_index) AS rank, target_index AS neuron_index, contacts, row_number() OVER (PARTITION BY type ORDER BY contacts DESC, target_index) = 1 AS watch FROM (SELECT type, target_index, sum(synapse_count)::BIGINT AS contacts FROM edges JOIN neurons ON target_index = neuron_index WHERE source_index < 300 AND type IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1, 2) QUALIFY rank <= 6")
def panel_preset(s, d):
    n = v.neurons(s, d)
    return service.preset(n, v.edges(s, d), n.where("neuron_index < 300"), ["Brand#11", "Brand#12", "Brand#13"], 6)


@query(W("edges") + graphs._LAYERS + """, walks AS (SELECT target FROM between_ WHERE hop = 0 AND target_index = target UNION ALL SELECT a.target FROM between_ a JOIN between_ b ON a.target = b.target AND a.hop = 0 AND b.hop = 1 AND a.target_index = b.source_index AND b.target_index = a.target UNION ALL SELECT target FROM layers WHERE layer = 0 AND node = target),
w AS (SELECT target, count(*) AS n FROM walks GROUP BY 1) SELECT target, length, count(*) FILTER (layer BETWEEN 1 AND length - 1) AS relays, least(12, any_value(n)) AS paths FROM layers JOIN w USING (target) GROUP BY target, length""")
def pathway_catalog(s, d):
    n, e, layers = graphs._layers(s, d)
    paths = graph.ranked_paths(layers, graph.layer_edges(n, e, layers), 12, 2)
    return service.pathway_catalog(layers, paths).select("target", "length", "relays", F.size("paths").alias("paths"))


@query("SELECT user_id AS session, count(*) AS chunks, sum(0.02)::DOUBLE AS simulated_s, round(sum(value), 4) AS wall_s, sum(event_id % 5)::BIGINT AS total_spikes, arg_max(event_id % 5, event_id) AS last_spikes, round(sum(0.02) / sum(value), 8) AS speed_ratio FROM events GROUP BY 1")
def session_snapshot(s, d):
    c = v.read(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("chunk"), F.lit(0.02).alias("simulated_s"), F.col("value").alias("wall_s"), (F.col("event_id") % 5).alias("spikes"))
    out = service.snapshot(c)
    return out.withColumns({"simulated_s": F.round("simulated_s", 4), "wall_s": F.round("wall_s", 4), "speed_ratio": F.round("speed_ratio", 8)})


@query("WITH w AS (SELECT DISTINCT user_id AS session, (event_id // 2000) * 2000 AS from_chunk, event_id % 3 AS neuron_index FROM events WHERE event_id % 7 = 0), u AS (SELECT session, from_chunk, lead(from_chunk) OVER (PARTITION BY session ORDER BY from_chunk) AS until FROM (SELECT DISTINCT session, from_chunk FROM w)), l AS (SELECT w.*, until FROM w JOIN u USING (session, from_chunk)) SELECT e.event_id AS chunk, e.user_id AS session, e.event_id % 4 AS neuron_index FROM events e JOIN l ON l.session = e.user_id AND l.neuron_index = e.event_id % 4 AND e.event_id >= from_chunk AND (until IS NULL OR e.event_id < until)")
def dynamic_watch(s, d):
    e = v.read(s, d, "events")
    lists = e.where("event_id % 7 = 0").select(F.col("user_id").alias("session"), (F.floor(F.col("event_id") / 2000) * 2000).alias("from_chunk"), (F.col("event_id") % 3).alias("neuron_index")).distinct()
    return service.watched(e.select(F.col("event_id").alias("chunk"), F.col("user_id").alias("session"), (F.col("event_id") % 4).alias("neuron_index")), lists)


@query("SELECT event_id, round_even((value - 50) * 0.05::DOUBLE * 10.0::DOUBLE, 0)::BIGINT AS pixel_dx, round_even((50 - value) * 0.025::DOUBLE * 10.0::DOUBLE, 0)::BIGINT AS pixel_dy FROM events")
def pointer_dry_run(s, d):
    x = F.col("value")
    c = v.read(s, d, "events").select("event_id", ((x - 50) * 0.05).alias("dx"), ((50 - x) * 0.025).alias("dy"))
    return service.pointer_moves(c, 10.0).select("event_id", "pixel_dx", "pixel_dy")


@query("SELECT event_id, least(1.0, greatest(0.0, value / 99.0)) AS x FROM events")
def cursor_position(s, d):
    return v.read(s, d, "events").select("event_id", sc.position(F.col("value"), F.lit(100.0)).alias("x"))
