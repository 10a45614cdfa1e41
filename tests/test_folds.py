"""Folds in blocks against plain loops: any block size gives the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import decode, folds, graph, normalize, signals
from spindrift.streaming import telemetry


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(k, i, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice(["start", "pause", "resume", "finish", "nonsense", None])) for k, n in (("a", 130), ("b", 7), (None, 40)) for i in range(n)]
    rng.shuffle(made)
    return spark.createDataFrame(made, "k string, i long, x double, y double, action string"), sorted(made, key=lambda r: (str(r[0]), r[1]))


def groups(made):
    out = {}
    for r in made:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(params=[10**6, 16])
def block(request, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", request.param)
    monkeypatch.setattr(folds.folded, "__defaults__", (request.param,))


def test_low_pass(rows, block):
    got = {(r.k, r.position): r.filtered for r in signals.low_pass_fold(rows[0], ["k"], "x", "i", 0.25, 3.0).collect()}
    want = {}
    for k, g in groups(rows[1]).items():
        y = 3.0
        for p, r in enumerate(g):
            y += 0.25 * (r[2] - y)
            want[k, p] = y
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_walk_and_hysteresis(rows, block):
    path = {(r.k, r.position): (r.x, r.y) for r in decode.cursor_path(rows[0], ["k"], "i", "x", "y", 0.3).collect()}
    actions = {(r.k, r.position): r.action for r in decode.hysteresis(rows[0], ["k"], "i", "x", 0.5).collect()}
    for k, g in groups(rows[1]).items():
        x, y, last = 0.5, 0.5, 0
        for p, r in enumerate(g):
            x, y = min(1, max(0, x + r[2] * 0.3)), min(1, max(0, y + r[3] * 0.3))
            assert path[k, p] == pytest.approx((x, y), abs=1e-12)
            raw = 1 if r[2] >= 0 else -1
            last = last if last and raw != last and abs(r[2]) < 0.5 else raw
            assert actions[k, p] == last


def test_states(rows, block):
    got = {(r.k, r.position): (r.action, r.state, r.legal) for r in telemetry.session_states(rows[0], ["k"], ["i"]).collect()}
    for k, g in groups(rows[1]).items():
        state = "idle"
        for p, r in enumerate(g):
            state, legal = telemetry.next_state(state, r[4])
            assert got[k, p] == (r[4], state, legal)


def test_folds_of_nothing_and_of_one_group(rows, block):
    assert signals.low_pass_fold(rows[0].where("false"), ["k"], "x", "i", 0.1, 0.0).count() == 0
    one = folds.folded(rows[0].where("k = 'a'"), [], ["i"], {"x": F.col("x")}, folds.low_pass(0.5, 0.0), "filtered double")
    assert one.columns == ["position", "filtered"] and one.count() == 130


def test_dense_index_of_clustered_keys(spark, monkeypatch):
    monkeypatch.setattr(normalize, "RANGE_ROWS", 20)
    ids = [*range(3000), 2**60, -(2**40)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    n, number = normalize.key_ranges(df, "id")
    sizes = df.groupBy(number.alias("r")).count().toPandas()["count"]
    assert n == 3002 and len(sizes) > 100 and sizes.max() < 200
    got = {r.id: r.neuron_index for r in normalize.dense_index(df, "id").collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids))}
    assert normalize.dense_index(df.where("false"), "id").count() == 0


def test_loocv_sets(spark):
    rng = np.random.default_rng(2)
    made = [(s, i, rng.normal(0, 1, 3).tolist(), int(rng.integers(2))) for s in range(3) for i in range(9)] + [(9, 0, [1.0, 2.0, 3.0], 1)]
    samples = spark.createDataFrame(made, "set long, row long, features array<double>, target long")
    grid = spark.createDataFrame([(2, 0.1, 0.5), (3, 1.0, None)], "components int, alpha double, gamma double")
    got = {(r.set, r.components): r.score for r in decode.loocv_sets(samples, grid).collect()}
    for s in range(3):
        own = samples.where(F.col("set") == s).drop("set")
        for r in decode.loocv(own, grid, "classification").collect():
            assert got[s, r.components] == pytest.approx(r.score)
    assert got[9, 2] is None
    with pytest.raises(ValueError, match="samples"):
        decode.loocv(samples, grid, most=5)


def test_search_against_plain(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(90)})
    signs = {i: rng.choice([-1, 0, 1]) for i in range(40)}
    n = spark.createDataFrame(list(signs.items()), "neuron_index int, sign int")
    e = spark.createDataFrame([(a, b, 1) for a, b in edges], "source_index int, target_index int, synapse_count int")
    for forward in (True, False):
        want, frontier = {0: 0, 5: 0}, {0, 5}
        for hop in range(1, 4):
            frontier = {b if forward else a for a, b in edges if signs[a] and (a if forward else b) in frontier} - want.keys()
            want |= dict.fromkeys(frontier, hop)
        got = graph.distances(n, e, n.where("neuron_index in (0, 5)"), 3, forward)
        assert {r.node: r.distance for r in got.collect()} == want
