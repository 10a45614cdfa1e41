"""Decoders from aggregated moments against fits of the same rows in one place, and over every row of their tables."""

import numpy as np
import pytest

from spindrift import catalog
from spindrift.operators import decode as dec


def _samples(spark, n, constant=False):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6)) + 50
    if constant:
        x[:, 2] = 7
    y = x[:, 0] - 2 * x[:, 4] + rng.normal(size=n)
    return x, spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(n)], "row long, features array<double>, target double").repartition(5)


@pytest.mark.parametrize("constant", [False, True])
def test_ridge_from_moments(spark, constant):
    _, samples = _samples(spark, 40, constant)
    grid = spark.createDataFrame([(c, a, None) for c in (1, 2, 6) for a in (0.1, 10.0)], "components int, alpha double, gamma double")
    got, want = ({(r.components, r.alpha): (r.n, r.score) for r in f(samples, grid).collect()} for f in (dec.ridge_loocv, dec.loocv))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-8) for k in want)


def test_pca_from_moments(spark):
    x, samples = _samples(spark, 40)
    assert np.allclose(dec.pca_projection(samples, "features", 3)(x), dec.pca(x, 3)(x))
    _, samples = _samples(spark, 40, constant=True)
    assert dec.pca_projection(samples, "features", 6)(x).shape == (40, 5)


def test_queries_use_every_row(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert n > 28
    assert {r.n for r in catalog.queries()["ridge_loocv"](spark, sf).collect()} == {n}
    scores = catalog.queries()["pca_scores"](spark, sf).toPandas()
    assert scores["row"].nunique() == len(scores) == n


def test_scores_of_two_labels_and_of_many(spark):
    from spindrift.operators import decode as dec

    rng = np.random.default_rng(1)
    rows = [(int(i % 2), [float(x) for x in rng.normal(size=3) + (i % 2) * np.array([2.0, 0.0, 0.1])]) for i in range(80)]
    two = spark.createDataFrame(rows, "label int, f array<double>")
    want = {r.feature: r.score for r in dec.fisher_scores(two, "f", "label").collect()}
    got = {(r.label, r.feature): r.score for r in dec.rest_scores(two, "f", "label").collect()}
    assert all(abs(got[k, f] - want[f]) < 1e-9 for k in (0, 1) for f in want)
    assert [r.feature for r in dec.top_features(dec.fisher_scores(two, "f", "label"), 1).collect()] == [0]
    odd = spark.createDataFrame([(None, [1.0]), (1, [2.0]), (1, [2.0])], "label int, f array<double>")
    assert [(r.label, r.score) for r in dec.rest_scores(odd, "f", "label").collect()] == [(1, 1.0 / 1e-9)]
    assert dec.rest_scores(odd.where("label = 1"), "f", "label").first().score is None
    assert {r["rank"] for r in dec.top_per_label(dec.rest_scores(two, "f", "label"), 2).collect()} == {1, 2}
