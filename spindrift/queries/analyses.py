"""Layer and population responses, direction joins, sensitivity and telemetry analyses over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import scalars as sc
from spindrift.operators import responses as r
from spindrift.queries import views as v
from spindrift.queries.measures import rounded

QUERIES, ORACLE = {}, {}
W = v.with_


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: v.longs(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(W("neurons") + "SELECT neuron_index, coalesce(s_acctbal, 0.5)::DOUBLE AS intensity FROM neurons LEFT JOIN supplier ON s_suppkey = body_id")
def fill_background(s, d):
    known = v.read(s, d, "supplier").select(F.col("s_suppkey").alias("body_id"), F.col("s_acctbal").alias("intensity"))
    return r.filled(v.neurons(s, d).select("neuron_index", "body_id"), known, "body_id", "intensity", 0.5).select("neuron_index", "intensity")


def _grid(s, d):
    raw = v.read(s, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "L").otherwise("R").alias("side"), (F.col("c_custkey") % 30).cast("int").alias("raw_p"), F.col("c_nationkey").cast("int").alias("raw_q"), "c_custkey")
    official = v.read(s, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "L").otherwise("R").alias("side"), (F.col("s_suppkey") % 30).cast("int").alias("p"), F.col("s_nationkey").cast("int").alias("q")).distinct()
    return raw, official


_GRID = "WITH raw AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'R' END AS side, c_custkey % 30 AS raw_p, c_nationkey AS raw_q, c_custkey FROM customer), official AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'L' ELSE 'R' END AS side, s_suppkey % 30 AS p, s_nationkey AS q FROM supplier) "


@query(_GRID + "SELECT raw.side, p, q, c_custkey FROM raw JOIN official o ON o.side = raw.side AND p = raw_p + CASE WHEN raw.side = 'R' THEN 1 ELSE 0 END AND q = raw_q")
def direction_join(s, d):
    return r.official_directions(*_grid(s, d)).select("side", "p", "q", "c_custkey")


@query(_GRID + "SELECT raw.side, count(*) AS n FROM raw WHERE NOT EXISTS (FROM official o WHERE o.side = raw.side AND p = raw_p + CASE WHEN raw.side = 'R' THEN 1 ELSE 0 END AND q = raw_q) GROUP BY 1")
def direction_unmatched(s, d):
    return r.unmatched(*_grid(s, d))


@query("SELECT count(*) FILTER (c.c_custkey IS NULL) AS missing, round(max(sqrt((s_acctbal - c_acctbal) * (s_acctbal - c_acctbal) + (s_nationkey - c_nationkey) * (s_nationkey - c_nationkey))), 4) AS max_error FROM (SELECT s_suppkey * 20 AS k, s_acctbal, s_nationkey FROM supplier) s LEFT JOIN customer c ON c_custkey = k")
def anchor_check(s, d):
    a = v.read(s, d, "supplier").select((F.col("s_suppkey") * 20).alias("k"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    b = v.read(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return rounded(r.anchor_error(b, a, ["k"], ["x", "y"]), "max_error", digits=4)


@query("WITH e AS (SELECT vec_id // 2 AS pair, CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, embedding[1]::DOUBLE AS f, embedding[2]::DOUBLE AS r, embedding[3]::DOUBLE AS u FROM embeddings), n AS (SELECT pair, side, f / sqrt(f * f + r * r + u * u) AS f, r / sqrt(f * f + r * r + u * u) AS r, u / sqrt(f * f + r * r + u * u) AS u FROM e) SELECT a.pair, round(degrees(acos(greatest(-1.0, least(1.0, a.f * b.f - a.r * b.r + a.u * b.u)))), 4) AS angle_deg FROM n a JOIN n b ON a.pair = b.pair AND a.side = 'R' AND b.side = 'L'")
def bilateral_symmetry(s, d):
    e = v.read(s, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), F.when(F.col("vec_id") % 2 == 0, "L").otherwise("R").alias("side"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("fru")])
    norm = F.sqrt(F.col("f") * F.col("f") + F.col("r") * F.col("r") + F.col("u") * F.col("u"))
    unit = e.select("pair", "side", *[(F.col(c) / norm).alias(c) for c in "fru"])
    return rounded(r.mirror_angle(unit, ["pair"], "side", "f", "r", "u"), "angle_deg", digits=4)


_TRACE = ", tr AS (SELECT neuron, value - 50 AS v, CASE WHEN value > 90 THEN 1 ELSE 0 END AS spikes FROM spikes), ly AS (SELECT i % 3 AS target, (i // 3) % 4 AS layer, i AS neuron FROM range(200) q(i)), pk AS (SELECT neuron, max(abs(v)) AS peak, sum(spikes) AS spikes FROM tr GROUP BY 1)"


@query(W("spikes") + _TRACE + "SELECT target, layer, count(*) AS members, round(max(coalesce(peak, 0)), 4) AS max_peak, round(quantile_cont(coalesce(peak, 0)::DOUBLE, 0.5), 4) AS median_peak, count(*) FILTER (peak >= 40) AS responsive, count(*) FILTER (peak > 1e-12) AS moved, count(*) FILTER (spikes > 0) AS spiking FROM ly LEFT JOIN pk USING (neuron) GROUP BY 1, 2")
def layer_response(s, d):
    tr = v.spikes(s, d).select("neuron", (F.col("value") - 50).alias("v"), F.when(F.col("value") > 90, 1).otherwise(0).alias("spikes"))
    ly = s.range(200).select((F.col("id") % 3).alias("target"), (F.floor(F.col("id") / 3) % 4).alias("layer"), F.col("id").alias("neuron"))
    return rounded(r.layer_response(tr, ly, 40.0), "max_peak", "median_peak", digits=4)


@query(W("spikes") + ", h AS (SELECT population, neuron % 6 AS hop, sum(CASE WHEN value > 98 THEN 1 ELSE 0 END) AS spikes, CASE WHEN neuron % 6 < 4 THEN sum(value) ELSE 0 END AS drive FROM spikes GROUP BY population, neuron % 6) SELECT population, min(hop) FILTER (drive = 0) AS first_silent_hop, coalesce(max(hop) FILTER (drive <> 0), 0) AS last_driven_hop, min(hop) FILTER (spikes > 0) AS first_spike_hop FROM h GROUP BY 1")
def hop_milestones(s, d):
    hop = F.col("neuron") % 6
    h = v.spikes(s, d).groupBy("population", hop.alias("hop")).agg(F.sum(F.when(F.col("value") > 98, 1).otherwise(0)).alias("spikes"), F.sum("value").alias("drive")).withColumn("drive", F.when(F.col("hop") < 4, F.col("drive")).otherwise(0.0))
    return r.hop_milestones(h, ["population"], "hop", "drive", "spikes")


_PEAKS = ", pk AS (SELECT population, neuron, max(value - 50) AS v, min(value - 50) AS g, count(*) AS n FROM spikes GROUP BY 1, 2), pp AS (SELECT population, count(*) AS members, avg(v) AS mean_v, avg(abs(v)) AS mean_abs_v, max(abs(v)) AS max_abs_v, avg(g) AS mean_g, avg(abs(g)) AS mean_abs_g, max(abs(g)) AS max_abs_g, sum(n)::BIGINT AS spikes FROM pk GROUP BY 1)"


def _peaks(s, d):
    pk = v.spikes(s, d).groupBy("population", "neuron").agg(F.max(F.col("value") - 50).alias("v"), F.min(F.col("value") - 50).alias("g"), F.count("*").alias("n"))
    return r.population_peaks(pk, ["population"], "v", "g", "n")


@query(W("spikes") + _PEAKS + "SELECT population, members, round(mean_v, 4) AS mean_v, round(mean_abs_v, 4) AS mean_abs_v, round(max_abs_v, 4) AS max_abs_v, round(mean_g, 4) AS mean_g, round(mean_abs_g, 4) AS mean_abs_g, round(max_abs_g, 4) AS max_abs_g, spikes FROM pp")
def population_peaks(s, d):
    return rounded(_peaks(s, d), "mean_v", "mean_abs_v", "max_abs_v", "mean_g", "mean_abs_g", "max_abs_g", digits=4)


@query(W("spikes") + _PEAKS + "SELECT 0 AS run, round(max(mean_v) FILTER (population = 'click') - max(mean_v) FILTER (population = 'view'), 4) AS difference FROM pp")
def channel_difference(s, d):
    return rounded(r.channel_difference(_peaks(s, d).withColumn("run", F.lit(0)), ["run"], "population", "mean_v", "click", "view"), "difference", digits=4)


@query(W("spikes") + ", t AS (SELECT neuron, time_d, value - 102 AS v, -value AS g FROM spikes), p AS (SELECT neuron, greatest(0.0, max(-52 - v)) AS depth, min(v) AS min_v, min(g) AS min_g FROM t GROUP BY 1) SELECT count(*) AS members, count(*) FILTER (depth >= 45) AS responsive, round(quantile_cont(depth, 0.5), 4) AS median_depth, round(max(depth), 4) AS max_depth, round(min(min_v), 4) AS min_v, round(min(min_g), 4) AS min_g, (SELECT round(min(time_d) - 1.5, 6) FROM t WHERE -52 - v >= 45) AS latency, (SELECT round(max(time_d) - min(time_d), 6) FROM t WHERE -52 - v >= 45) AS persistence FROM p")
def direct_response(s, d):
    tr = v.spikes(s, d).select("neuron", "time_d", (F.col("value") - 102).alias("v"), (-F.col("value")).alias("g"))
    out = r.direct_response(tr, "neuron", "time_d", "v", "g", -52.0, 45.0, 1.5)
    return rounded(rounded(out, "median_depth", "max_depth", "min_v", "min_g", digits=4), "latency", "persistence")


@query(W("frames") + ", k AS (SELECT frame, count(*) FILTER (intensity > 0.4::DOUBLE + 1e-9) AS active, sum(x * greatest(0.0, intensity - 0.4)) / nullif(sum(greatest(0.0, intensity - 0.4)), 0) AS c FROM frames GROUP BY 1) SELECT frame, active, round(c, 6) AS centroid, coalesce(c > lag(c) OVER (ORDER BY frame), true) AS rises FROM k")
def sweep_metrics(s, d):
    return rounded(r.sweep(v.frames(s, d), 0.4, "frame", "x", "intensity"), "centroid")


@query(W("neurons", "spikes") + ", b AS (SELECT type, side, neuron % 5 AS axis, bool_or(value > 60) AS keep, bool_or(value < 3) AS wrong, avg(value) AS e FROM spikes JOIN neurons ON neuron = neuron_index GROUP BY 1, 2, 3), st AS (SELECT *, CASE WHEN keep AND NOT wrong THEN 'preserving' WHEN wrong AND NOT keep THEN 'reversed' ELSE 'mixed' END AS status FROM b) SELECT type, count(*) AS evaluations, count(*) FILTER (status = 'preserving') AS preserving, round(avg((status = 'preserving')::INT), 6) AS preserving_share, count(*) FILTER (status = 'reversed') AS reversed, round(avg((status = 'reversed')::INT), 6) AS reversed_share, count(*) FILTER (status = 'mixed') AS mixed, round(avg((status = 'mixed')::INT), 6) AS mixed_share, round(avg(e), 4) AS mean_error, count(DISTINCT axis) AS axes, count(DISTINCT side) AS targets FROM st GROUP BY 1")
def cross_target_summary(s, d):
    j = v.spikes(s, d).withColumnRenamed("neuron", "neuron_index").join(v.neurons(s, d), "neuron_index")
    b = j.groupBy("type", "root_side", (F.col("neuron_index") % 5).alias("axis")).agg(F.bool_or(F.col("value") > 60).alias("keep"), F.bool_or(F.col("value") < 3).alias("wrong"), F.avg("value").alias("e"))
    out = r.cross_target(b.withColumn("status", r.group_status(F.col("keep"), F.col("wrong"))), ["type"], "status", "e", "axis", "root_side")
    return rounded(rounded(out, "preserving_share", "reversed_share", "mixed_share"), "mean_error", digits=4)


@query("SELECT coalesce((CASE WHEN user_id % 7 < 5 THEN user_id % 7 END)::VARCHAR, 'none') AS first_failed_hop, count(*) AS n FROM events GROUP BY 1")
def failure_histogram(s, d):
    hop = F.when(F.col("user_id") % 7 < 5, F.col("user_id") % 7)
    return r.failure_histogram(v.read(s, d, "events").select(hop.alias("hop")), "hop")


@query("SELECT user_id % 8 AS setting, round(max(value), 4) AS largest, round(max(value) - min(value), 4) AS \"range\", bool_or(event_id % 1000 = 7) AS any_spike FROM events GROUP BY 1")
def sensitivity_summary(s, d):
    e = v.read(s, d, "events").select((F.col("user_id") % 8).alias("setting"), "value", (F.col("event_id") % 1000 == 7).cast("int").alias("spikes"))
    return rounded(r.sensitivity(e, ["setting"], "value", "spikes"), "largest", "range", digits=4)


@query("SELECT c_mktsegment AS k, count(*) AS n, round(avg((((c_custkey % 97) > 48) = (c_acctbal > 4000))::INT), 6) AS side_accuracy FROM (SELECT *, c_custkey % 97 AS p FROM customer) WHERE c_acctbal <> 4000 GROUP BY 1")
def side_accuracy(s, d):
    c = v.read(s, d, "customer").select(F.col("c_mktsegment").alias("k"), (F.col("c_acctbal") - 4000).alias("a"), (F.col("c_custkey") % 97 - 48).alias("p"))
    return rounded(r.side_accuracy(c, ["k"], "a", "p", 0.0), "side_accuracy")


@query(W("spikes") + "SELECT neuron, count(*) AS spikes, round(count(*) / 30.0::DOUBLE, 6) AS rate_hz, round(least(1.0, count(*) / 30.0::DOUBLE / 2.5), 6) AS brightness FROM spikes WHERE neuron % 2 = 0 GROUP BY 1")
def activity_frame(s, d):
    chosen = s.range(0, 1_000_000, 2).select(F.col("id").alias("neuron"))
    return rounded(r.activity_frame(v.spikes(s, d), chosen, "neuron", 30.0, 2.5), "rate_hz", "brightness")


@query(W("trade") + "SELECT source_index, target_index, round(degrees(atan2(target_index - 12, source_index - 12)), 6) AS angle_deg, round(synapse_count / max(synapse_count) OVER (PARTITION BY source_index)::DOUBLE, 6) AS strength FROM trade")
def replay_angles(s, d):
    t = v.trade(s, d).withColumns({"dx": (F.col("source_index") - 12).cast("double"), "dy": (F.col("target_index") - 12).cast("double"), "score": (F.col("synapse_count") * F.col("sign")).cast("double")})
    return rounded(r.replay_angles(t, ["source_index"], "dx", "dy", "score"), "angle_deg", "strength").select("source_index", "target_index", "angle_deg", "strength")


@query(W("spikes") + ", g AS (SELECT neuron, time_d AS after, lead(time_d) OVER (PARTITION BY neuron ORDER BY time_d) - time_d AS silence FROM spikes) SELECT neuron, round(after, 6) AS after, (ceil(silence / 0.5) - 1)::BIGINT AS beats FROM g WHERE silence > 0.5")
def heartbeats(s, d):
    return rounded(r.heartbeats(v.spikes(s, d), ["neuron"], "time_d", 0.5), "after")


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'non_finite' WHEN value > 95 THEN 'wall_s' WHEN value > 90 THEN 'spikes' WHEN user_id > 140 THEN 'edges' END AS stop FROM events")
def budget_stop(s, d):
    e = v.read(s, d, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(1.0).alias("voltage"), F.col("value").alias("wall_s"), F.col("value").alias("spikes"), F.col("user_id").alias("edges"))
    return r.budget_stop(e, {"wall_s": 95.0, "spikes": 90.0, "edges": 140}).select("event_id", "stop")


@query("WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT event_type, round(med, 6) AS median, round(med / (SELECT med FROM m WHERE event_type = 'click') * 100 - 100, 6) AS percent FROM m")
def percent_difference(s, d):
    return rounded(r.percent_difference(v.read(s, d, "events"), "event_type", "value", "click"), "median", "percent")


@query("SELECT s_nationkey AS \"column\", CASE WHEN s_suppkey % 2 = 0 THEN 'L2' ELSE 'L1' END AS kind, min(s_suppkey) AS source FROM supplier GROUP BY 1, 2 HAVING count(DISTINCT s_suppkey) = 1")
def cartridge_sources(s, d):
    x = v.read(s, d, "supplier").select(F.col("s_nationkey").alias("column"), F.when(F.col("s_suppkey") % 2 == 0, "L2").otherwise("L1").alias("kind"), F.col("s_suppkey").alias("source"))
    alone = x.groupBy("column", "kind").agg(F.count_distinct("source").alias("n")).where("n = 1").drop("n")
    return r.unique_sources(x.join(alone, ["column", "kind"]), "column", "kind", "source")


@query("SELECT event_id, CASE WHEN regexp_full_match(t, '\\s*\\d{1,16}\\s*(,\\s*\\d{1,16}\\s*)*') THEN list_sum(list_transform(string_split(t, ','), lambda x: trim(x)::BIGINT))::BIGINT END AS total FROM (SELECT event_id, event_id || ', ' || CASE WHEN event_id % 9 = 0 THEN '-1' ELSE user_id::VARCHAR END AS t FROM events)")
def index_lists(s, d):
    t = F.concat_ws(", ", "event_id", F.when(F.col("event_id") % 9 == 0, "-1").otherwise(F.col("user_id").cast("string")))
    return v.read(s, d, "events").select("event_id", sc.index_list(t).alias("xs")).select("event_id", F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT p_partkey, CASE WHEN abs((p_size * 0.05::DOUBLE) / 0.1 - rint) < 1e-9 THEN rint::BIGINT END AS steps FROM (SELECT *, round_even(p_size * 0.05::DOUBLE / 0.1, 0) AS rint FROM part)")
def grid_alignment(s, d):
    return v.read(s, d, "part").select("p_partkey", sc.whole_steps(F.col("p_size") * 0.05, 0.1).alias("steps"))


