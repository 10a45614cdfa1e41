"""Screens, encodings, feature rows, chosen neurons and readouts over the derived views."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spindrift.functions import scalars as sc
from spindrift.operators import decode as dec
from spindrift.operators import events as ev
from spindrift.operators import features as ft
from spindrift.operators import graph as g
from spindrift.operators import metrics as m
from spindrift.operators import pathways as pw
from spindrift.operators import populations as pop
from spindrift.operators import responses as rs
from spindrift.operators import signals as sig
from spindrift.operators import vision as vis
from spindrift.plans import eye as eyes
from spindrift.streaming import telemetry as t
from spindrift.queries import graphs, measures
from spindrift.queries import views as v

QUERIES, ORACLE = {}, {}
W = v.with_
rounded = measures.rounded


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: v.longs(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# screens and encodings


@query(W("frames") + "SELECT count(DISTINCT frame) AS frames, max(y) + 1 AS height, max(x) + 1 AS width, CASE WHEN count(*) <> count(DISTINCT frame) * (max(y) + 1) * (max(x) + 1) THEN 'missing pixels' END AS reason FROM frames")
def frame_admission(s, d):
    return vis.admit(v.frames(s, d), 100, 1000)


@query(W("frames") + "SELECT frame, round(avg(intensity), 6) AS luminance FROM frames GROUP BY 1")
def uniform_luminance(s, d):
    return rounded(vis.uniform_luminance(v.frames(s, d)), "luminance")


_SCREEN = vis.Screen(width=16, height=9, bar_width=0.2)


def _bar_sql(extent: str, position: str) -> str:
    return f"BETWEEN round_even(({position} - 0.1::DOUBLE) * ({extent} - 1), 0) AND round_even(({position} + 0.1::DOUBLE) * ({extent} - 1), 0)"


@query(f"SELECT f.i AS frame, y.i AS y, x.i AS x, CASE WHEN x.i {_bar_sql('16', 'f.i * 0.25::DOUBLE')} THEN 0.0 ELSE 0.5 END::DOUBLE AS intensity FROM range(5) f(i), range(9) y(i), range(16) x(i)")
def bar_frames(s, d):
    return vis.bar_frames(s, "horizontal", [0.0, 0.25, 0.5, 0.75, 1.0], _SCREEN)


def _conditions(s, d):
    """Nations as conditions: kind by region, axis by parity, position over the screen."""
    n = v.read(s, d, "nation")
    kind = F.when(F.col("n_regionkey") == 0, "baseline").when(F.col("n_regionkey") < 3, "dark").otherwise("bright")
    return n.select(F.col("n_nationkey").alias("condition"), kind.alias("kind"), F.when(F.col("n_nationkey") % 2 == 0, "horizontal").otherwise("vertical").alias("axis"), (F.col("n_nationkey") / 24).alias("position"))


_CONDITIONS = "c AS (SELECT n_nationkey AS condition, CASE WHEN n_regionkey = 0 THEN 'baseline' WHEN n_regionkey < 3 THEN 'dark' ELSE 'bright' END AS kind, n_nationkey % 2 = 0 AS across, n_nationkey / 24.0::DOUBLE AS position FROM nation)"


@query(f"WITH {_CONDITIONS} SELECT condition, f.i AS frame, y.i AS y, x.i AS x, CASE WHEN kind <> 'baseline' AND f.i BETWEEN 1 AND 2 AND ((across AND x.i {_bar_sql('16', 'position')}) OR (NOT across AND y.i {_bar_sql('9', 'position')})) THEN CASE kind WHEN 'dark' THEN 0.0 ELSE 1.0 END ELSE 0.5 END::DOUBLE AS intensity FROM c, range(4) f(i), range(9) y(i), range(16) x(i)")
def condition_frames(s, d):
    return vis.condition_frames(_conditions(s, d), _SCREEN, 1, 2, 1)


def _directions(s, d):
    return v.read(s, d, "embeddings").select(F.col("vec_id").alias("key"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("forward", "right", "up"))])


_ENCODED = """, e AS (SELECT vec_id AS key, embedding[1]::DOUBLE AS f, embedding[2]::DOUBLE AS r, embedding[3]::DOUBLE AS u FROM embeddings), p AS (SELECT key, f, r / f / tan(radians(120.0) / 2) AS x, u / f / tan(radians(90.0) / 2) AS y FROM e),
w AS (SELECT key, (x + 1) / 2 * 7 AS fx, (1 - y) / 2 * 5 AS fy FROM p WHERE f > 0 AND abs(x) <= 1 AND abs(y) <= 1),
k AS (SELECT key, least(floor(fx) + dx, 7)::INT AS x, least(floor(fy) + dy, 5)::INT AS y, (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) AS w FROM w, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)),
encoded AS (SELECT key, frame, sum(intensity * w) AS intensity FROM k JOIN frames USING (x, y) GROUP BY 1, 2)"""


def _encoded(s, d):
    return vis.encode(v.frames(s, d), _directions(s, d), 8, 6, (120.0, 90.0), 60.0, 0.5)


@query(W("frames") + _ENCODED + " SELECT key, frame, round(0.5 + frame / 60.0::DOUBLE, 6) AS time_s, round(intensity, 6) AS intensity FROM encoded")
def screen_sequence(s, d):
    return rounded(_encoded(s, d), "time_s", "intensity")


@query(W("neurons", "frames") + _ENCODED + ", n AS (SELECT neuron_index, neuron_index // 3 AS key FROM neurons), t AS (SELECT DISTINCT frame FROM frames) SELECT neuron_index, n.key, t.frame, round(coalesce(intensity, 0.5), 6) AS intensity FROM n CROSS JOIN t LEFT JOIN encoded e ON e.key = n.key AND e.frame = t.frame")
def screen_to_neurons(s, d):
    columns = v.neurons(s, d).select("neuron_index", F.floor(F.col("neuron_index") / 3).alias("key"))
    return rounded(vis.expand(_encoded(s, d), columns, v.frames(s, d).select("frame")), "intensity").select("neuron_index", "key", "frame", "intensity")


@query(W("frames") + "SELECT count(*) AS frames, sha256(string_agg(h, ',' ORDER BY frame)) AS sha256 FROM (SELECT frame, sha256(frame || '|' || string_agg(y || ':' || x || ':' || round_even(intensity / 1e-9::DOUBLE, 0)::BIGINT, ',' ORDER BY y, x)) AS h FROM frames GROUP BY frame)")
def frame_content_hash(s, d):
    return vis.content_hash(v.frames(s, d))


_VISION = sig.EarlyVision(frame_rate_hz=100.0)


def _gain(tau: float) -> str:
    return f"{1 - math.exp(-_VISION.dt_ms / tau)!r}::DOUBLE"


def _recursive_vision() -> str:
    """The filters as a recursive query: a row per channel and step."""
    c = _VISION
    rest = c.tonic + (1 - c.tonic) * c.background
    per = round(1000 / c.frame_rate_hz / c.dt_ms)
    return f""", lum AS (SELECT channel, l, row_number() OVER (PARTITION BY channel ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY channel) AS n FROM (SELECT x AS channel, frame, avg(intensity) AS l FROM frames GROUP BY 1, 2)),
walk AS (SELECT DISTINCT channel, -1 AS step, n, 0.0::DOUBLE AS l, {c.background}::DOUBLE AS p, {rest!r}::DOUBLE AS rel, {rest!r}::DOUBLE AS f, {rest!r}::DOUBLE AS s, {rest!r}::DOUBLE AS t FROM lum
UNION ALL SELECT channel, step, n, l, p, rel, f + {_gain(c.fast_ms)} * (rel - f), s + {_gain(c.slow_ms)} * (rel - s), t + {_gain(c.l3_ms)} * (rel - t) FROM (SELECT *, {c.tonic}::DOUBLE + {1 - c.tonic!r}::DOUBLE * p AS rel FROM (SELECT w.channel, w.step + 1 AS step, w.n, lum.l, w.p + {_gain(c.photoreceptor_ms)} * (lum.l - w.p) AS p, f, s, t FROM walk w JOIN lum ON lum.channel = w.channel AND lum.k = (w.step + 1) // {per} WHERE w.step + 1 < w.n * {per})))"""


def _luminance(s, d):
    return v.frames(s, d).groupBy("frame", F.col("x").alias("channel")).agg(F.avg("intensity").alias("luminance"))


@query(W("frames", recursive=True) + _recursive_vision() + f" SELECT channel, step, round(p, 6) AS photoreceptor, round(rel, 6) AS release, round(-6.0::DOUBLE * (f - s), 6) AS l1, round(-6.0::DOUBLE * (f - 1.05::DOUBLE * s + 0.05::DOUBLE * {_VISION.tonic + (1 - _VISION.tonic) * _VISION.background!r}::DOUBLE), 6) AS l2, round(-6.0::DOUBLE * (t - {_VISION.tonic + (1 - _VISION.tonic) * _VISION.background!r}::DOUBLE), 6) AS l3 FROM walk WHERE step >= 0")
def graded_vision(s, d):
    return rounded(sig.graded_channels(_luminance(s, d), _VISION), "photoreceptor", "release", "l1", "l2", "l3")


@query(W("frames", recursive=True) + _recursive_vision() + f" SELECT channel, step, round(l, 6) AS luminance, round(p, 6) AS state, round(rel, 6) AS release, round(rel - {_VISION.tonic + (1 - _VISION.tonic) * _VISION.background!r}::DOUBLE, 6) AS release_delta FROM walk WHERE step >= 0")
def photoreceptor_channels(s, d):
    return rounded(vis.photoreceptors(_luminance(s, d), _VISION), "luminance", "state", "release", "release_delta")


@query(W("frames") + f", {_CONDITIONS}, k AS (SELECT x AS col, 4 + x AS sources, x / 7.0::DOUBLE AS coordinate, avg(intensity) FILTER (frame BETWEEN 1 AND 2) AS mean, max(intensity) - 0.4 AS peak, min(intensity) - 0.4 AS low FROM frames GROUP BY x), j AS (SELECT condition, kind, k.*, CASE kind WHEN 'dark' THEN mean < 0.5 - 1e-9 WHEN 'bright' THEN mean > 0.5 + 1e-9 ELSE false END AS a, CASE WHEN kind = 'dark' THEN greatest(0.0, peak) END AS w FROM c, k) SELECT condition, kind, count(*) FILTER (a) AS active_columns, coalesce(sum(sources) FILTER (a), 0)::BIGINT AS active_sources, round(avg(CASE WHEN CASE WHEN kind = 'dark' THEN peak > 0 ELSE low < 0 END THEN 1.0 ELSE 0.0 END) FILTER (a), 6) AS expected_sign, round(CASE WHEN sum(w) <> 0 THEN sum(coordinate * w) / sum(w) END, 6) AS centroid, round(max(greatest(abs(peak), abs(low))), 6) AS max_abs_drive, round(max(peak), 6) AS max_drive, round(min(low), 6) AS min_drive, round(max(peak * 2), 6) AS max_voltage, round(min(low * 2), 6) AS min_voltage FROM j GROUP BY 1, 2")
def condition_summary(s, d):
    f = v.frames(s, d)
    means = vis.window_mean(f.withColumnRenamed("x", "col"), ["col"], 1, 2)
    k = f.groupBy(F.col("x").alias("col")).agg((F.max("intensity") - 0.4).alias("peak"), (F.min("intensity") - 0.4).alias("low")).join(means, "col")
    k = k.withColumns({"sources": F.col("col") + 4, "coordinate": F.col("col") / 7.0, "background": F.lit(0.5), "v_peak": F.col("peak") * 2, "v_low": F.col("low") * 2})
    out = m.condition_summary(_conditions(s, d).select("condition", "kind").crossJoin(F.broadcast(k)))  # 8 columns
    return rounded(out, "expected_sign", "centroid", "max_abs_drive", "max_drive", "min_drive", "max_voltage", "min_voltage")


# traces and features


_TRACE = ", t AS (SELECT floor(time_d)::BIGINT AS chunk, event_id AS step, neuron, population, value - 50 AS v, value / 7 AS g FROM spikes)"


def _trace(s, d):
    return v.spikes(s, d).select(F.floor("time_d").alias("chunk"), F.col("event_id").alias("step"), "neuron", "population", (F.col("value") - 50).alias("v"), (F.col("value") / 7).alias("g"))


@query(W("spikes") + _TRACE + ", l AS (SELECT chunk, neuron, arg_max(v, step) AS v, arg_max(g, step) AS g FROM t GROUP BY 1, 2) SELECT (neuron % 3)::BIGINT AS population, chunk, round(avg(v + 52), 6) AS voltage, round(avg(g), 6) AS drive FROM l GROUP BY 1, 2")
def population_state(s, d):
    t = _trace(s, d)
    return rounded(m.population_state(t, t.select((F.col("neuron") % 3).alias("population"), "neuron").distinct(), -52.0), "voltage", "drive")


@query(W("spikes") + _TRACE + ", r AS (SELECT DISTINCT neuron FROM t WHERE neuron % 4 = 1), l AS (SELECT chunk, neuron, arg_max(v, step) AS v, arg_max(g, step) AS g, count(*) FILTER (v > 0) AS n FROM t WHERE neuron % 4 = 1 GROUP BY 1, 2) SELECT chunk, count(*) AS neurons, round(avg(v), 6) AS voltage_mean, round(avg(g), 6) AS drive_mean, sum(n)::BIGINT AS spikes FROM l GROUP BY 1")
def pathway_measurement(s, d):
    t = _trace(s, d)
    route = t.where("neuron % 4 = 1").select("neuron").distinct()
    return rounded(m.pathway_measurement(t, route, t.where("v > 0").groupBy("chunk", "neuron").agg(F.count("*").alias("spikes"))), "voltage_mean", "drive_mean")


@query(W("spikes") + ", w AS (SELECT neuron, row_number() OVER (ORDER BY neuron) - 1 AS col FROM (SELECT DISTINCT neuron FROM spikes WHERE population = 'click')), r AS (SELECT DISTINCT neuron AS position, neuron FROM spikes WHERE population = 'view') SELECT position, r.neuron, col AS \"column\" FROM r LEFT JOIN w ON w.neuron = r.neuron")
def route_positions(s, d):
    e = v.spikes(s, d)
    route = e.where("population = 'view'").select("neuron").distinct().withColumn("position", F.col("neuron"))
    return m.route_positions(route, e.where("population = 'click'").select("neuron"))


@query(W("spikes") + ", q AS (SELECT population, floor(time_d) AS time, quantile_cont(value, 0.5) AS value FROM spikes GROUP BY 1, 2) SELECT population, round(max(abs(value)), 6) AS abs_peak, round(min(value) FILTER (time >= 10 AND time < 20), 6) AS stimulus_min, round(max(value) FILTER (time >= 10 AND time < 20), 6) AS stimulus_max, round(avg(value) FILTER (time >= 17.5 AND time < 20), 6) AS late_mean, round(coalesce(min(value) FILTER (time >= 20), 0.0), 6) AS post_min, round(coalesce(max(value) FILTER (time >= 20), 0.0), 6) AS post_max FROM q GROUP BY 1")
def median_signal_metrics(s, d):
    q = m.median_trace(v.spikes(s, d).withColumn("time", F.floor("time_d").cast("double")), ["population"], "time", "value")
    return rounded(m.windowed_signal(q, ["population"], "value", "time", 10.0, 20.0), "abs_peak", "stimulus_min", "stimulus_max", "late_mean", "post_min", "post_max")


_DRIVE = ", k AS (SELECT population AS label, floor(time_d)::BIGINT AS step, avg(value) - 50 AS amplitude FROM spikes GROUP BY 1, 2)"


def _drive(s, d):
    return v.spikes(s, d).groupBy(F.col("population").alias("label"), F.floor("time_d").alias("step")).agg((F.avg("value") - 50).alias("amplitude"))


@query(W("spikes") + _DRIVE + " SELECT label, step - 7 AS step, round(amplitude, 6) AS amplitude FROM k WHERE step >= 7 AND step < 19")
def drive_slice(s, d):
    return rounded(ft.slice_drive(_drive(s, d), 7, 19), "amplitude").select("label", "step", "amplitude")


@query(W("spikes", "edges") + _DRIVE + ", p AS (SELECT DISTINCT label, row_number() OVER (ORDER BY label) - 1 AS i FROM (SELECT DISTINCT label FROM k)), w AS (SELECT label, target_index, sum(synapse_count) AS weight FROM edges JOIN p ON source_index % 5 = i WHERE source_index < 400 GROUP BY 1, 2) SELECT step, target_index, round(sum(amplitude * weight), 5) AS drive FROM k JOIN w USING (label) WHERE amplitude <> 0 GROUP BY 1, 2")
def projected_drive(s, d):
    labels = ["click", "purchase", "refund", "signup", "view"]
    k = _drive(s, d)
    order = k.select("label").distinct().groupBy().agg(F.sort_array(F.collect_set("label")).alias("labels"))  # a handful of names
    w = v.edges(s, d).where("source_index < 400").crossJoin(F.broadcast(order)).withColumn("label", F.try_element_at("labels", (F.col("source_index") % len(labels) + 1).cast("int"))).where("label is not null")
    return rounded(ft.projected_drive(k, w.groupBy("label", "target_index").agg(F.sum("synapse_count").alias("weight"))), "drive", digits=5)


@query(W("spikes") + ", x AS (SELECT neuron, value - 50 AS v, value / 7 AS g FROM spikes WHERE time_d >= 6.0 / 2.0) SELECT neuron, round(CASE WHEN abs(max(v)) >= abs(min(v)) THEN max(v) ELSE min(v) END, 6) AS voltage, round(CASE WHEN abs(max(g)) >= abs(min(g)) THEN max(g) ELSE min(g) END, 6) AS drive FROM x GROUP BY 1")
def window_features(s, d):
    x = ft.feature_window(v.spikes(s, d), "time_d", 6, 2.0).withColumn("g", F.col("value") / 7)
    return rounded(ft.window_features(x, ["neuron"], "value", "g", 50.0), "voltage", "drive")


@query("SELECT vec_id, len(embedding) * 3 AS size, round((list_sum(embedding::DOUBLE[]) + list_sum(embedding::DOUBLE[]) * 2 + len(embedding))::DOUBLE, 4) AS total, round((embedding[1] * 2)::DOUBLE, 6) AS first_drive FROM embeddings")
def modality_vectors(s, d):
    e = v.read(s, d, "embeddings").withColumn("voltage", F.col("embedding").cast("array<double>"))
    e = e.withColumns({"drive": F.transform("voltage", lambda x: x * 2), "spike": F.transform("voltage", lambda x: F.lit(1.0))}).withColumn("features", ft.feature_vector("concat"))
    n = F.size("voltage")
    return e.select("vec_id", F.size("features").alias("size"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.element_at("features", n + 1), 6).alias("first_drive"))


@query("SELECT w.i AS \"at\", vec_id::DOUBLE AS key, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings JOIN (VALUES (0, 9), (1, 2), (2, 5)) w(i, k) ON vec_id = k")
def matrix_rows(s, d):
    e = v.read(s, d, "embeddings").withColumn("voltage", F.col("embedding").cast("array<double>"))
    return ft.keyed_rows(e, [9, 2, 5], "vec_id", ft.feature_vector("voltage")).select("at", "key", F.round(F.col("features")[0], 6).alias("first"))


@query("SELECT user_id, arg_max(struct_pack(p := part, event_id, value), (part, event_id)).event_id AS event_id, arg_max(value, (part, event_id)) AS value FROM (SELECT *, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS part FROM events) GROUP BY 1")
def later_artifacts_win(s, d):
    e = v.read(s, d, "events").select("user_id", "event_id", "value", "event_type")
    return ft.latest_rows([e.where("event_type <> 'view'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")], "user_id")


@query(W("neurons", "spikes") + ", c AS (SELECT population AS run, neuron, count(*)::DOUBLE AS spikes, round(max(value), 6) AS peak FROM spikes GROUP BY 1, 2), j AS (SELECT run, superclass AS population, type || '_' || side AS instance, body_id, spikes, peak FROM c JOIN neurons ON neuron = neuron_index WHERE superclass IN ('STANDARD', 'ECONOMY')), l AS (SELECT run, CASE superclass_ WHEN 'STANDARD' THEN 1 ELSE 2 END AS p, body_id, m, superclass_ || ':' || instance || ':' || body_id || ':' || CASE m WHEN 0 THEN 'spikes' ELSE 'peak' END AS name, CASE m WHEN 0 THEN spikes ELSE peak END AS value FROM (SELECT *, population AS superclass_ FROM j), range(2) r(m)) SELECT run, row_number() OVER (PARTITION BY run ORDER BY p, body_id, m) - 1 AS \"at\", name, value FROM l")
def member_features(s, d):
    c = v.spikes(s, d).groupBy(F.col("population").alias("run"), F.col("neuron").alias("neuron_index")).agg(F.count("*").alias("spikes"), F.round(F.max("value"), 6).alias("peak"))
    members = c.join(v.neurons(s, d).select("neuron_index", F.col("superclass").alias("population"), "instance", "body_id"), "neuron_index")
    return ft.member_features(members, ["run"], ["STANDARD", "ECONOMY"], ["spikes", "peak"]).select("run", "at", "name", "value")


@query(W("spikes") + ", c AS (SELECT neuron AS run, population, count(*)::DOUBLE AS n FROM spikes GROUP BY 1, 2) SELECT run, max(n) FILTER (population = 'view') AS f0, max(n) FILTER (population = 'click') AS f1 FROM c GROUP BY 1")
def population_vectors(s, d):
    c = v.spikes(s, d).groupBy(F.col("neuron").alias("run"), "population").agg(F.count("*").cast("double").alias("n"))
    return ft.population_vector(c, ["run"], ["view", "click"], "n").select("run", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


# chosen neurons


_ASSIGNED = ", a AS (SELECT source AS neuron_index, status, c AS col, candidates FROM inferred)"


def _assigned(s, d):
    i = m.infer_columns(v.contacts(s, d), 12, 0.16, 0.1)
    return i.select(F.col("source").alias("neuron_index"), "status", "column", "candidates")


@query(W("contacts") + graphs._INFER + ", k AS (SELECT c AS col, source FROM inferred WHERE status IN ('unique', 'dominant') AND c % 2 = 1) SELECT col AS \"column\", count(*) AS members, min(source) AS first_member, max(source) AS last_member FROM k GROUP BY 1")
def source_groups(s, d):
    visible = v.read(s, d, "nation").where("n_nationkey % 2 = 1").select(F.col("n_nationkey").cast("long").alias("column"))
    return pw.group_sizes(pw.source_groups(_assigned(s, d), ["unique", "dominant"], visible))


@query(W("contacts") + graphs._INFER + ", a AS (SELECT source, CASE WHEN status IN ('unique', 'dominant', 'low') THEN c END AS col FROM inferred), o AS (SELECT col, count(*) AS n FROM a WHERE col IS NOT NULL GROUP BY 1) SELECT count(*) AS sources, count(col) AS assigned, round(count(col) / count(*)::DOUBLE, 6) AS assigned_fraction, (SELECT count(*) FROM o) AS covered, (SELECT count(*) FILTER (n = 6) FROM o) AS complete, (SELECT count(*) FILTER (n > 6) FROM o) AS above FROM a")
def mapping_counts(s, d):
    return rounded(pw.mapping_counts(_assigned(s, d)), "assigned_fraction")


@query(W("contacts") + graphs._INFER + ", a AS (SELECT candidates, CASE WHEN status IN ('unique', 'dominant', 'low') THEN c END AS col FROM inferred) SELECT 'candidates' AS name, candidates::BIGINT AS value, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'occupancy', k, count(*) FROM (SELECT count(*) AS k FROM a WHERE col IS NOT NULL GROUP BY col) GROUP BY 2")
def mapping_histograms(s, d):
    return pw.mapping_histograms(_assigned(s, d))


def _paths(s, d):
    return graphs._layers(s, d)


@query(W("edges") + graphs._walk("neuron_index < 3", True) + " SELECT neuron_index, distance AS hop FROM d2 JOIN neurons ON node = neuron_index WHERE distance >= 1 AND superclass = 'ECONOMY'")
def watch_within_hops(s, d):
    n, e = graphs._written(s, d)
    return pw.within_hops(g.distances(n, e, n.where("neuron_index < 3"), 2), n, "ECONOMY", 2)


@query(W("edges") + graphs._LAYERS + " SELECT DISTINCT neuron_index FROM layers JOIN neurons ON node = neuron_index WHERE layer >= 1 AND layer < length AND superclass IN ('ECONOMY', 'STANDARD', 'SMALL') AND type <> 'Brand#12'")
def path_relays(s, d):
    n, _, layers = _paths(s, d)
    return pw.relays(layers, n, ["ECONOMY", "STANDARD", "SMALL"], ["Brand#12"])


@query(W("edges") + graphs._LAYERS + " SELECT DISTINCT neuron_index FROM layers JOIN neurons ON node = neuron_index WHERE layer = 1 AND target % 2 = 0 AND type LIKE 'Brand#_1'")
def typed_layer(s, d):
    n, _, layers = _paths(s, d)
    types = [f"Brand#{i}1" for i in range(10)]
    return pw.typed_layer(layers, n, n.where("neuron_index % 2 = 0"), types, layer=1)


@query(W("neurons") + ", b AS (SELECT neuron_index FROM neurons WHERE superclass = 'ECONOMY'), r AS (SELECT neuron_index FROM neurons WHERE side = 'L'), a AS (SELECT neuron_index FROM neurons WHERE type = 'Brand#12') SELECT 'baseline' AS variant, count(*) AS n FROM b UNION ALL SELECT 'remove', count(*) FROM (FROM b EXCEPT FROM r) UNION ALL SELECT 'add', count(*) FROM (FROM b UNION FROM a) UNION ALL SELECT 'combined', count(*) FROM ((FROM b EXCEPT FROM r) UNION FROM a)")
def causal_variants(s, d):
    n = v.neurons(s, d)
    return pw.variants(g.select(n, superclass="ECONOMY"), g.select(n, root_side="L"), g.select(n, type="Brand#12")).groupBy("variant").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS variant, l_linenumber AS axis, count(*) AS targets, count(*) FILTER (l_quantity > 25) AS hop_passes, count(*) FILTER (l_discount > 0.05) AS target_passes, round(avg(l_discount), 6) AS mean_hop_error, round(avg(l_tax), 6) AS mean_target_error FROM lineitem GROUP BY 1, 2")
def variant_summary(s, d):
    r = v.read(s, d, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("axis"), (F.col("l_quantity") > 25).alias("hop_pass"), (F.col("l_discount") > 0.05).alias("target_pass"), F.col("l_discount").alias("hop_error"), F.col("l_tax").alias("target_error"))
    return rounded(pw.variant_summary(r, ["variant", "axis"]), "mean_hop_error", "mean_target_error")


@query(W("edges") + graphs._walk("neuron_index < 3", True) + " SELECT neuron_index, body_id, type || '_' || side AS instance, type, superclass, distance AS hop FROM neurons LEFT JOIN d2 ON node = neuron_index WHERE neuron_index % 10 = 3")
def annotation_records(s, d):
    n, e = graphs._written(s, d)
    return pw.annotation_records(n.where("neuron_index % 10 = 3"), n, g.distances(n, e, n.where("neuron_index < 3"), 2)).select("neuron_index", "body_id", "instance", "type", "superclass", "hop")


@query(W("edges") + graphs._LAYERS + " SELECT (SELECT count(*) FROM neurons WHERE neuron_index < 3) AS sources, count(DISTINCT target) AS targets, count(DISTINCT node) FILTER (layer = 1) AS first_hop, count(DISTINCT node) FILTER (layer BETWEEN 1 AND length - 1) AS interior, count(DISTINCT node) FILTER (layer >= 1 AND node >= 3) AS watched, count(DISTINCT node) FILTER (layer BETWEEN 1 AND length - 1 AND superclass = 'ECONOMY') AS relays FROM layers JOIN neurons ON neuron_index = node")
def anatomy_summary(s, d):
    n, _, layers = _paths(s, d)
    return pw.anatomy(layers, n.where("neuron_index < 3").select("neuron_index"), n, ["ECONOMY"])


@query(W("edges") + graphs._LAYERS + " SELECT layer, count(DISTINCT node) AS nodes FROM layers GROUP BY 1")
def layer_union_counts(s, d):
    return pw.layer_counts(_paths(s, d)[2])


_OFFICIAL = ", official AS (SELECT s_suppkey AS col, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 7 END AS body_id FROM supplier)"


def _official(s, d):
    return v.read(s, d, "supplier").select(F.col("s_suppkey").alias("column"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") * 7).alias("body_id"))


@query(W("neurons") + _OFFICIAL + " SELECT col AS \"column\", neuron_index FROM official JOIN neurons n ON n.body_id = official.body_id")
def official_neurons(s, d):
    return pw.official_by_index(_official(s, d), v.neurons(s, d))


@query(W("edges") + _OFFICIAL + ", o AS (SELECT col, neuron_index FROM official JOIN neurons n ON n.body_id = official.body_id) SELECT source_index AS source, col AS \"column\", sum(synapse_count)::BIGINT AS contacts FROM edges JOIN o ON target_index = o.neuron_index JOIN neurons q ON q.neuron_index = source_index WHERE q.superclass = 'ECONOMY' GROUP BY 1, 2")
def official_contacts(s, d):
    n, e = graphs._written(s, d)
    return pw.column_contacts(e, g.select(n, superclass="ECONOMY"), pw.official_by_index(_official(s, d), n), n.where("type = 'Brand#12'"))[0]


@query(W("edges") + ", t AS (SELECT source_index, bool_or(type = 'Brand#12') AS hit FROM edges JOIN neurons ON target_index = neuron_index GROUP BY 1) SELECT neuron_index AS source, coalesce(hit, false) AS any_typed FROM neurons LEFT JOIN t ON source_index = neuron_index WHERE superclass = 'ECONOMY'")
def typed_reach(s, d):
    n, e = graphs._written(s, d)
    return pw.column_contacts(e, g.select(n, superclass="ECONOMY"), pw.official_by_index(_official(s, d), n), n.where("type = 'Brand#12'"))[1]


_CARTRIDGES = ", cart AS (SELECT neuron_index // 3 AS col, 'L' || (neuron_index % 3 + 1) AS kind, neuron_index AS source FROM neurons WHERE superclass = 'ECONOMY')"


def _cartridges(n):
    return g.select(n, superclass="ECONOMY").select(F.floor(F.col("neuron_index") / 3).alias("column"), F.concat(F.lit("L"), F.col("neuron_index") % 3 + 1).alias("kind"), F.col("neuron_index").alias("source"))


@query(W("edges") + _CARTRIDGES + " SELECT kind, col AS \"column\", target_index, sum(synapse_count * sign)::BIGINT AS weight FROM edges JOIN cart ON source = source_index JOIN neurons ON neuron_index = source WHERE sign <> 0 GROUP BY 1, 2, 3 HAVING sum(synapse_count * sign) <> 0")
def lamina_projections(s, d):
    n, e = graphs._written(s, d)
    return pw.lamina_projections(_cartridges(n), n, e)


@query(W("neurons") + _CARTRIDGES + " SELECT kind, count(DISTINCT source) AS sources, min(sign)::BIGINT AS lowest, max(sign)::BIGINT AS highest FROM cart JOIN neurons ON neuron_index = source GROUP BY 1 HAVING min(sign) <> -1 OR max(sign) <> -1")
def unexpected_signs(s, d):
    n = graphs._written(s, d)[0]
    return pw.unexpected_signs(pw.source_signs(_cartridges(n), n), {"L1": -1, "L2": -1, "L3": -1})


@query(W("neurons") + ", sp(key, t, s) AS (VALUES ('a', 'Brand#12', NULL), ('b', 'Brand#21', 'L')) SELECT key, row_number() OVER (PARTITION BY key ORDER BY body_id) AS rank, neuron_index, body_id FROM neurons JOIN sp ON type = t AND (s IS NULL OR s = side) WHERE superclass = 'ECONOMY'")
def motor_populations(s, d):
    return pw.motor_populations(v.neurons(s, d), [("a", "Brand#12", None), ("b", "Brand#21", "L")], "ECONOMY")


@query("WITH r AS (SELECT l_suppkey AS target, l_returnflag AS axis, l_linenumber AS hop, count(*) AS members, max(abs(l_discount - 0.05)) AS max_drive, sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END)::BIGINT AS spikes FROM lineitem GROUP BY 1, 2, 3) SELECT target, axis, hop, members, round(max_drive, 6) AS max_drive, spikes, min(hop) FILTER (max_drive = 0) OVER w AS first_silent_hop, coalesce(max(hop) FILTER (max_drive <> 0) OVER w, 0) AS last_driven_hop, min(hop) FILTER (spikes > 0) OVER w AS first_spike_hop FROM r WINDOW w AS (PARTITION BY target, axis)")
def response_records(s, d):
    r = v.read(s, d, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("axis"), F.col("l_linenumber").alias("hop"), (F.col("l_discount") - 0.05).alias("drive"), F.when(F.col("l_tax") > 0.07, 1).otherwise(0).alias("spikes"))
    return rounded(pw.response_records(r, ["target", "axis"], "hop", "drive", "spikes"), "max_drive")


@query(W("neurons") + ", a AS (SELECT neuron_index FROM neurons WHERE superclass = 'ECONOMY'), b AS (SELECT neuron_index FROM neurons WHERE side = 'L') SELECT (SELECT count(*) FROM a SEMI JOIN b USING (neuron_index)) AS shared, (SELECT count(*) FROM a ANTI JOIN b USING (neuron_index)) AS missing")
def set_relations(s, d):
    n = v.neurons(s, d)
    return pw.set_relations(g.select(n, superclass="ECONOMY"), g.select(n, root_side="L"), "neuron_index")


# commands and held-out rows


@query(W("spikes") + ", k AS (SELECT floor(time_d)::BIGINT AS chunk, coalesce(avg(value - 50) FILTER (population = 'click'), 0.0) - coalesce(avg(value - 50) FILTER (population = 'view'), 0.0) AS h, 0.0 - coalesce(avg(value - 50) FILTER (population = 'purchase'), 0.0) AS w FROM spikes GROUP BY 1) SELECT chunk, round(greatest(-2.0, least(2.0, CASE WHEN abs(h) <= 0.5 THEN 0.0 ELSE h END * 0.5)), 6) AS dx, round(greatest(-2.0, least(2.0, CASE WHEN abs(w) <= 0.5 THEN 0.0 ELSE w END * 0.25)), 6) AS dy, false AS click FROM k")
def motor_voltage(s, d):
    name = F.when(F.col("population") == "click", "steer_right").when(F.col("population") == "view", "steer_left").when(F.col("population") == "purchase", "forward")
    k = v.spikes(s, d).withColumn("name", name).groupBy(F.floor("time_d").alias("chunk"), "name").agg(F.avg(F.col("value") - 50).alias("x"))
    state = k.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "x")))).alias("state"))
    return rounded(dec.voltage_command(state, (0.5, 0.25), 0.5, 2.0).select("chunk", "dx", "dy", "click"), "dx", "dy")


@query("WITH c AS (SELECT o_orderkey AS chunk, (o_orderkey % 1000) * 0.02::DOUBLE AS a FROM orders), p AS (SELECT chunk, a, number, 0.013::DOUBLE + number * 0.007::DOUBLE AS t FROM c, range(400) r(number)) SELECT chunk, n.i AS neuron_index, number, round(round_even((t - a) / 0.0001::DOUBLE, 0) * 0.0001::DOUBLE, 6) + 0.0 AS time_s FROM p, (VALUES (3), (8)) n(i) WHERE t >= a - 1e-9 AND t < least(a + 0.02, 2.5) - 1e-9")
def chunk_pulses(s, d):
    c = v.read(s, d, "orders").select(F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") % 1000 * 0.02).alias("from_s")).withColumn("to_s", F.col("from_s") + 0.02)
    return rounded(sig.chunk_pulses(c, s.createDataFrame([(3,), (8,)], "neuron_index int"), 0.013, 2.5, 0.007, 0.1), "time_s")


@query("WITH f AS (SELECT l_returnflag AS flag, covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) AS slope, avg(l_extendedprice) AS m, avg(l_quantity) AS q FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), t AS (SELECT flag, l_extendedprice AS y, m, m - slope * q + slope * l_quantity AS p FROM lineitem JOIN f ON flag = l_returnflag WHERE l_orderkey % 2 <> 0) SELECT flag, count(*) AS n, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(avg(CASE WHEN (p > m) = (y > m) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM t GROUP BY 1")
def heldout_affine(s, d):
    li = v.read(s, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    out = dec.heldout_affine(li, ["flag"], "l_quantity", "l_extendedprice", F.col("l_orderkey") % 2 == 0)
    return out.select("flag", "n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("accuracy", 6).alias("accuracy"))


@query()
def heldout_benchmark(s, d):
    """Every 28 embeddings by id are one experiment, every fourth of them held out; two modalities compete."""
    e = v.read(s, d, "embeddings").select(F.floor(F.col("vec_id") / 28).alias("set"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).alias("target"), (F.col("vec_id") % 4 != 0).alias("train"))
    both = F.array(F.struct(F.lit("first").alias("modality"), F.slice("x", 1, 16).alias("features")), F.struct(F.lit("second").alias("modality"), F.slice("x", 17, 16).alias("features")))
    samples = e.select("set", "row", "target", "train", F.explode(both).alias("m")).select("set", "row", "target", "train", "m.modality", "m.features")
    return rounded(dec.benchmark_sets(samples, measures._grid(s, (None, 0.05)), least=0.5), "train_score", "test_score")


@query(W("spikes") + "SELECT event_id, least(floor(time_d * 0.5 + 1e-12), 9)::BIGINT AS frame FROM spikes")
def frame_lookup(s, d):
    return v.spikes(s, d).select("event_id", sc.frame_at(F.col("time_d"), 0.5, 10).alias("frame"))


_PEAKS = _TRACE + ", p AS (SELECT neuron, max(abs(v)) AS peak_v, max(abs(g)) AS peak_g, max(v) AS max_v, min(v) AS min_v FROM t GROUP BY 1)"


@query(W("spikes") + _PEAKS + " SELECT count(*) AS watched, count(*) FILTER (peak_v >= 49) AS responsive, round(max(peak_v), 6) AS max_peak, round(quantile_cont(peak_v, 0.5), 6) AS median_peak, round(max(peak_g), 6) AS max_drive, round(max(max_v), 6) AS max_delta, round(min(min_v), 6) AS min_delta FROM p")
def subthreshold_summary(s, d):
    return rounded(rs.subthreshold(_trace(s, d), "neuron", "v", "g", 0.0, 49.0), "max_peak", "median_peak", "max_drive", "max_delta", "min_delta")


@query(W("spikes") + _PEAKS + " SELECT neuron, round(peak_v, 6) AS peak_v, round(peak_g, 6) AS peak_g FROM p ORDER BY p.peak_v DESC, neuron LIMIT 10")
def subthreshold_top(s, d):
    return rounded(rs.subthreshold_top(_trace(s, d), "neuron", "v", "g", 0.0), "peak_v", "peak_g")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp FROM events")
def utc_stamps(s, d):
    at = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return v.read(s, d, "events").select("event_id", sc.utc_stamp(at).alias("stamp"))


@query(W("neurons") + "SELECT row_number() OVER (ORDER BY body_id) AS rank, neuron_index FROM neurons WHERE superclass = 'ECONOMY' QUALIFY rank <= 7")
def reference_sample(s, d):
    specs = s.createDataFrame([("economy", "ECONOMY", None)], "key string, superclass string, sample_limit int")
    return pop.first(pop.resolve(v.neurons(s, d), specs, ["superclass"]), 7).select("rank", "neuron_index")


@query(W("edges") + graphs._LAYERS + " SELECT target, hop, row_number() OVER (PARTITION BY target, hop ORDER BY synapse_count DESC, source_index, target_index) AS rank, source_index, target_index, synapse_count FROM between_ QUALIFY rank <= 2")
def truncated_layers(s, d):
    return g.truncated_layers(g.layer_edges(*graphs._layers(s, d)), 2).select("target", "hop", "rank", "source_index", "target_index", "synapse_count")


@query("""WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'factorized-2d' WHEN 'click' THEN 'horizontal-1d' ELSE 'vertical-1d' END AS recording, user_id % 64 AS episode, event_id % 4096 AS step, value / 100 AS a, (event_id % 97) / 97.0::DOUBLE AS b, event_id FROM events)
SELECT step AS row, recording, recording || ':episode-' || (episode + 1) || ':step-' || step AS event_id, CASE recording WHEN 'factorized-2d' THEN 'horizontal,vertical' WHEN 'horizontal-1d' THEN 'horizontal' ELSE 'vertical' END AS axes, CASE recording WHEN 'factorized-2d' THEN 'LEFT,RIGHT,UP,DOWN' WHEN 'horizontal-1d' THEN 'LEFT,RIGHT' ELSE 'UP,DOWN' END AS labels,
CASE WHEN recording = 'vertical-1d' THEN 0.0 ELSE round(b - a, 6) END AS dx, CASE WHEN recording = 'horizontal-1d' THEN 0.0 ELSE round(a - b, 6) END AS dy, round(a - b, 6) AS distance_delta, b < a AS improved FROM r""")
def recorded_steps(s, d):
    e = v.read(s, d, "events")
    kind = F.when(F.col("event_type") == "view", "factorized-2d").when(F.col("event_type") == "click", "horizontal-1d").otherwise("vertical-1d")
    a, b = F.col("value") / 100, (F.col("event_id") % 97) / 97.0
    point = lambda x, y: F.struct(F.when(kind != "vertical-1d", x).alias("x"), F.when(kind != "horizontal-1d", y).alias("y"))
    steps = e.select(kind.alias("recording"), (F.col("user_id") % 64).alias("episode"), (F.col("event_id") % 4096).alias("step"), point(a, b).alias("before"), point(b, a).alias("after"), point(b, b).alias("target"), a.alias("distance_before"), b.alias("distance_after"), F.col("event_id").alias("row"))
    out = t.recorded_steps(steps.withColumn("step", F.col("step")))
    both = out.select("recording", "event_id", "axes", "labels", "dx", "dy", "distance_delta", "improved").withColumn("row", F.regexp_extract("event_id", "step-([0-9]+)$", 1).cast("long"))
    return rounded(both, "dx", "dy", "distance_delta")


@query(W("neurons") + ", m AS (SELECT * FROM neurons WHERE superclass = 'ECONOMY') SELECT 'transmitter' AS fact, coalesce(lower(coalesce(ground_truth_nt, consensus_nt)), 'missing') AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'sign', sign::VARCHAR, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'side', coalesce(side, 'missing'), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'instance', type || '_' || side, count(*) FROM m GROUP BY 2")
def anatomical_diagnosis(s, d):
    n = v.neurons(s, d)
    return pw.diagnosis(g.select(n, superclass="ECONOMY"), n)


@query("SELECT event_type, count(*) AS repeats, round(quantile_cont(value, 0.5), 6) AS median_s, round(quantile_cont(value, 0.95), 6) AS p95_s, round(quantile_cont(CASE WHEN value <> 0 THEN 2.5 / value END, 0.5), 6) AS median_ratio, count(DISTINCT user_id % 1) = 1 AS same_spikes, count(DISTINCT user_id) = 1 AS same_visited, max(user_id) AS max_memory FROM events GROUP BY 1")
def run_summary(s, d):
    runs = v.read(s, d, "events").select("event_type", F.col("value").alias("wall_s"), F.lit(2.5).alias("simulated_s"), (F.col("user_id") % 1).alias("spikes"), F.col("user_id").alias("visited"), F.col("user_id").alias("memory"))
    return rounded(m.run_summary(runs, ["event_type"]), "median_s", "p95_s", "median_ratio")


@query("SELECT event_id, round(greatest(0.1, least(0.9, 0.5 + (event_id % 10) / 10.0::DOUBLE - value / 100)), 6) AS seen FROM events")
def relative_positions(s, d):
    return v.read(s, d, "events").select("event_id", F.round(sc.relative_position(F.col("event_id") % 10 / 10.0, F.col("value") / 100, 0.5, 0.1, 0.9), 6).alias("seen"))


@query("SELECT l_returnflag AS flag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def finite_correlation(s, d):
    return v.read(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(m.finite_correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


# from the screen to the network: nations as the columns of an eye and as neurons

PROTOCOL = eyes.Protocol(1, 2, 1, _VISION, 1.0, 0.01, 0.002, 1.8)


def nation_eye(s, d) -> eyes.Eye:
    """A column ahead for each nation, on a 5 x 5 grid of directions; its sources are itself and the nations 7 and 13 on."""
    n = [r[0] for r in v.read(s, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # the eye's columns
    ahead = [(1.0, (k % 5 - 2) * 0.6, (k // 5 - 2) * 0.35) for k in n]
    return eyes.Eye(tuple(n), tuple(ahead), tuple({"l1": k, "l2": (k + 7) % len(n), "l3": (k + 13) % len(n)} for k in n))


def seen_conditions(s, d):
    """The conditions with their bars moved to where the eye has columns."""
    return _conditions(s, d).withColumn("position", F.col("position") * 0.4 + 0.3)


def _network(s, d):
    n = s.range(25).select(F.col("id").cast("int").alias("neuron_index"), F.when(F.col("id") % 2 == 1, -1).otherwise(1).alias("sign"))
    return ev.collect_graph(n, v.trade(s, d), 10_000)


@query()
def position_features(s, d):
    """Signed peaks of every nation's neuron under each condition of the screen; baselines, which drive nothing, are left out."""
    conditions = seen_conditions(s, d).where("kind <> 'baseline'")
    out = eyes.position_features(conditions, nation_eye(s, d), _SCREEN, PROTOCOL, _network(s, d), tuple(range(25)), bins=2)
    flat = out.select("condition", "neuron_index", "voltage", "drive", "spikes", *[F.col(f"temporal_{c}")[i].alias(f"{c}_{i}") for c in ("voltage", "drive") for i in (0, 1)], "total_spikes")
    return rounded(flat, "voltage", "drive", "voltage_0", "voltage_1", "drive_0", "drive_1")


@query()
def motor_ticks(s, d):
    """Motor commands every 5 ms while a bar shows, for every condition."""
    samples = eyes.column_samples(vis.condition_frames(seen_conditions(s, d), _SCREEN, 1, 2, 1), nation_eye(s, d), _SCREEN, PROTOCOL.frames)
    groups = {"left": (1, 3, 5), "right": (2, 4, 6), "up": (7,), "down": (8, 10), "click": (24,)}
    out = eyes.motor_sequence(samples, PROTOCOL.frames, nation_eye(s, d), _SCREEN.background, PROTOCOL, _network(s, d), groups, 5.0)
    return rounded(out.drop("rates", "voltages"), "start_s", "end_s", "dx", "dy", "peak_mv")
