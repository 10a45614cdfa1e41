"""Window metrics, similarity, inference, geometry and gates on fixtures with known results; nulls, ties and empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from spindrift.functions import scalars as sc
from spindrift.operators import metrics as m
from spindrift.operators import populations as pop
from spindrift.operators import signals as sig
from spindrift.operators.graph import with_sign


def test_population_sample(spark):
    n = spark.createDataFrame([(0, 40, "s", "t"), (1, 10, "s", "t"), (2, 30, "s", "u"), (3, 20, "s", "t")], "neuron_index int, body_id long, superclass string, type string")
    specs = spark.createDataFrame([("a", "t", 2), ("none", "x", None)], "key string, type string, sample_limit int")
    got = pop.resolve(n, specs, ["type"])
    assert [(r.body_id, r.neuron_index, r.available) for r in got.orderBy("rank").collect()] == [(10, 1, 3), (20, 3, 3)]
    assert [r.key for r in pop.empty(specs, got).collect()] == ["none"]
    a, b = (spark.createDataFrame(rows, "x int, position int") for rows in ([(5, 0), (3, 1)], [(3, 0), (9, 1)]))
    assert [r.x for r in pop.ordered_union("x", a, b).orderBy("position").collect()] == [5, 3, 9]
    assert pop.seeded_sample(n, "body_id", 2, 1).collect() == pop.seeded_sample(n, "body_id", 3, 1).collect()[:2]


def test_window_metrics(spark):
    s = spark.createDataFrame([("p", 3, 0.01), ("p", 3, 0.055), ("p", 4, 0.09), ("p", 4, 0.12)], "population string, neuron int, time_s double")
    members = spark.createDataFrame([("p", 2), ("silent", 3)], "population string, members long")
    got = {r.population: r for r in m.response(s, members, 0.05, 0.10, 0.25).collect()}
    p = got["p"]
    assert (p.baseline_spikes, p.stimulus_spikes, p.post_spikes) == (1, 2, 1)
    assert p.latency_s == pytest.approx(0.005) and p.duration_s == pytest.approx(0.065) and p.persistence_s == pytest.approx(0.02)
    assert got["silent"].no_response and got["silent"].latency_s is None and got["silent"].stimulus_hz == 0
    assert m.response(s.where("false"), members, 0.05, 0.1, 0.25).count() == 2


def test_similarity(spark):
    rows = [("a", 1, 2), ("b", 1, 1), ("b", 2, 1), ("silent", 1, 0)]
    got = {(r.left_run, r.right_run): r for r in m.similarity(spark.createDataFrame(rows, "run string, item int, count int")).collect()}
    assert got["a", "b"].cosine == pytest.approx(2**-0.5) and got["a", "b"].jaccard == 0.5
    assert got["a", "silent"].cosine is None and got["a", "silent"].reason


def test_columns(spark):
    rows = [(1, 7, 10), (2, 7, 4), (2, 8, 1), (3, 7, 9), (3, 8, 2), (4, 7, 7), (4, 8, 4), (5, 7, 5), (5, 8, 5), (6, 7, 2)]
    got = {r.source: (r.status, r.column) for r in m.infer_columns(spark.createDataFrame(rows, "source int, column int, contacts int"), 5, 0.8, 0.6).collect()}
    assert got == {1: ("unique", 7), 2: ("dominant", 7), 3: ("dominant", 7), 4: ("low", 7), 5: ("ambiguous", None), 6: ("unmapped", None)}


def test_edge_summary(spark):
    rows = [("PS077", "x", 5, 1), ("LLPC1", "x", 3, -1), (None, "y", 2, 1)]
    got = {(r.type, r.category): r for r in m.edge_groups(spark.createDataFrame(rows, "type string, category string, count int, sign int")).collect()}
    assert (got[None, None].contacts, got[None, None].signed) == (10, 4)
    assert (got["LLPC1", None].inhibitory, got["<none>", None].excitatory, got[None, "x"].signed) == (3, 2, 2)


def test_backprojection(spark):
    e = spark.createDataFrame([("L1", 10, -3), ("L1", 11, -1), ("L2", 10, 1), ("L2", 11, 3)], "target string, column int, weight int")
    got = {(r.target, r.column): r.share for r in m.backprojection(e, "target", "column", "weight").collect()}
    assert got == {("L1", 10): 0.75, ("L1", 11): 0.25, ("L2", 10): 0.25, ("L2", 11): 0.75}
    quiet = spark.createDataFrame([("L1", 0.0), ("L2", 0.0)], "target string, response double")
    assert {r.activity for r in m.backprojected(m.backprojection(e, "target", "column", "weight"), quiet, "target", "column", 0.0).collect()} == {0.0}


def test_safe_statistics(spark):
    df = spark.createDataFrame([("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0)], "k string, x double, y double")
    got = {r.k: r.r for r in df.groupBy("k").agg(m.correlation(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["flat"] is None and got["line"] == pytest.approx(1)
    assert df.where("false").agg(m.correlation(F.col("x"), F.col("y"))).first()[0] is None
    gates = m.gates(spark.createDataFrame([("a", 1.0), ("n", None)], "name string, value double"), spark.createDataFrame([("a", 0.0, 2.0), ("n", None, 1.0), ("gone", None, None)], "name string, low double, high double"))
    assert {r.name: r.passed for r in gates.collect()} == {"a": True, "n": False, "gone": False}


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda *c: tuple(one.select(*c).first())
    assert pick(*sc.label_parts(F.lit("ME_R_col_07_31")))[:3] == ("R", 7, 31) and pick(*sc.label_parts(F.lit("ME_X_col_1_1"))) == (None, None, None)
    assert pick(sc.label_of(F.lit("L"), F.lit(-3), F.lit(0))) == ("ME_L_col_18_16",)
    assert pick(*sc.screen(F.lit(1.0), F.lit(0.0), F.lit(0.0), 120.0, 90.0)) == (True, 0.5, 0.5)
    assert pick(*sc.screen(F.lit(-1.0), F.lit(0.0), F.lit(0.0), 120.0, 90.0)) == (False, None, None) == pick(*sc.screen(F.lit(0.0), F.lit(1.0), F.lit(0.0), 120.0, 90.0))
    assert pick(sc.normalized_goal(F.lit("  Find\tTHE  cat ")), sc.normalized_goal(F.lit(" \n"))) == ("find the cat", None)
    assert pick(sc.index_list(F.lit("1, 2,3")), sc.index_list(F.lit("1,,2")), sc.index_list(F.lit("1.5"))) == ([1, 2, 3], None, None)
    assert pick(sc.whole_steps(F.lit(2.2), 0.1), sc.whole_steps(F.lit(2.25), 0.1)) == (22, None)
    assert pick(sc.signed_peak(F.lit(2.0), F.lit(-2.0)), sc.half_up(F.lit(2.5)), sc.optional_id(F.lit(-99))) == (2.0, 3, None)
    assert pick(*sc.elevation_azimuth(F.lit(0.0), F.lit(1.0), F.lit(0.0))) == (0.0, 90.0)
    assert math.isclose(sc.filter_gain(0.1, 15.0), 1 - math.exp(-0.1 / 15))
    assert with_sign(spark.createDataFrame([(None, None)], "ground_truth_nt string, consensus_nt string")).first().sign == 0


def test_bilinear_corner(spark):
    frames = spark.createDataFrame([(0, y, x, float(10 * y + x)) for y in range(3) for x in range(4)], "frame int, y int, x int, intensity double")
    pts = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.5, 0.25)], "key int, u double, v double")
    got = {r.key: r.value for r in sig.bilinear(frames, pts, 4, 3).collect()}
    assert got[0] == pytest.approx(23.0) and got[1] == pytest.approx(6.5)
    assert sig.bilinear(frames.where("false"), pts, 4, 3).count() == 0
