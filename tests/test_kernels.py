"""Queries that SQL can't express, against plain computations on the same tables."""

import math

import numpy as np
import pytest

from spindrift import catalog
from spindrift.operators.events import Lif
from spindrift.queries import streams

Q = catalog.queries()
GRID = [(c, a) for c in (2, 4) for a in (0.1, 1.0)]


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = sorted((r.vec_id, list(map(float, r.embedding)), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] % 2 for r in rows])


def projected(train, rows, k):
    """Standardized by train, on train's first k principal components, from the covariance's eigenvectors."""
    mean, sd = train.mean(0), train.std(0)
    scale = np.where(sd > 1e-12, sd, np.inf)
    z, other = (train - mean) / scale, (rows - mean) / scale
    values, vecs = np.linalg.eigh(np.cov(z.T))
    v = vecs[:, ::-1][:, :k]
    return (z - z.mean(0)) @ v, (other - z.mean(0)) @ v


def plain_fit(x, y, rows, k, alpha, gamma):
    """Outputs of the pipeline for rows; the kernel's or the ridge's normal equations written out."""
    a, b = projected(x, rows, k)
    sd = a.std(0)
    scale = np.where(sd > 1e-12, sd, np.inf)
    a, b = (a - a.mean(0)) / scale, (b - a.mean(0)) / scale
    center = y.mean(0)
    if gamma:
        kernel = lambda p, q: np.array([[math.exp(-gamma * ((i - j) ** 2).sum()) for j in q] for i in p])
        return kernel(b, a) @ np.linalg.inv(kernel(a, a) + alpha * np.eye(len(a))) @ (y - center) + center
    return b @ np.linalg.inv(a.T @ a + alpha * np.eye(a.shape[1])) @ a.T @ (y - center) + center


def one_hot(y):
    return (y[:, None] == np.unique(y)[None]).astype(float)


def plain_score(x, y, k, alpha, gamma):
    good = 0
    for i in range(len(x)):
        keep = np.arange(len(x)) != i
        hot = one_hot(y)
        good += plain_fit(x[keep], hot[keep], x[i : i + 1], k, alpha, gamma)[0].argmax() == hot[i].argmax()
    return good / len(x)


def test_ridge_loocv(spark, sf, vectors):
    _, x, y = vectors
    got = {(r.components, r.alpha): (r.n, r.score) for r in Q["ridge_loocv"](spark, sf).collect()}
    for k, alpha in GRID:
        errors = []
        for i in range(len(x)):
            keep = np.arange(len(x)) != i
            errors.append(abs(plain_fit(x[keep], y[keep, None].astype(float), x[i : i + 1], k, alpha, None)[0, 0] - y[i]))
        assert got[k, alpha] == (len(x), pytest.approx(np.mean(errors), abs=2e-6))


def test_pca_scores(spark, sf, vectors):
    ids, x, _ = vectors
    _, v = np.linalg.eigh(np.cov(x.T))
    v = v[:, ::-1][:, :3]
    v = v * np.sign(v[np.abs(v).argmax(0), range(3)])
    want = dict(zip(ids.tolist(), (x - x.mean(0)) @ v, strict=True))
    got = Q["pca_scores"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        np.testing.assert_allclose([r.pc1, r.pc2, r.pc3], want[r.row], atol=1e-9)


def test_rbf_loocv_best(spark, sf, vectors):
    ids, x, y = vectors
    got = {r.set: r for r in Q["rbf_loocv_best"](spark, sf).collect()}
    assert set(got) == set((ids // 28).tolist())
    for s in sorted(got)[:3]:
        own = ids // 28 == s
        scored = {(k, a, g): plain_score(x[own], y[own], k, a, g) for k, a in GRID for g in (0.05, 0.5)}
        r = got[s]
        assert r.n == own.sum() and r.score == pytest.approx(scored[r.components, r.alpha, r.gamma])
        assert r.score == pytest.approx(max(scored.values())) and (r.components, r.alpha, r.gamma) == min(k for k, v in scored.items() if v > max(scored.values()) - 1e-9)


def test_heldout_benchmark(spark, sf, vectors):
    ids, x, y = vectors
    rows = Q["heldout_benchmark"](spark, sf).collect()
    assert sorted(r.row for r in rows) == [i for i in ids.tolist() if i % 4 == 0]
    for s in (0, 2):
        own = ids // 28 == s
        i, train = ids[own], ids[own] % 4 != 0
        parts = {"first": x[own][:, :16], "second": x[own][:, 16:32]}
        scored = {(m, k, a, g): plain_score(p[train], y[own][train], k, a, g) for m, p in parts.items() for k, a in GRID for g in (0.0, 0.05)}
        mine = [r for r in rows if r.set == s]
        r = mine[0]
        assert r.train_score == pytest.approx(max(scored.values()), abs=1e-6)
        m, k, a, g = min((q for q, v in scored.items() if v > max(scored.values()) - 1e-9))
        assert (r.modality, r.components, r.alpha, r.gamma or 0.0) == (m, k, a, g)
        out = plain_fit(parts[m][train], one_hot(y[own][train]), parts[m][~train], k, a, g)
        guess = dict(zip(i[~train].tolist(), np.unique(y[own][train])[out.argmax(1)], strict=True))
        assert all(q.predicted == guess[q.row] and q.actual == y[own][i == q.row][0] for q in mine)
        assert r.test_score == pytest.approx(np.mean([q.predicted == q.actual for q in mine]), abs=1e-6) and r.passes == (r.test_score >= 0.5)


def plain_lif(edges, signs, pulses, steps, amplitude, config=Lif()):
    """Spikes (step, neuron) and edges visited, neuron by neuron."""
    n = len(signs)
    v, g, r, due, spikes, visited = [config.resting] * n, [0.0] * n, [0] * n, {}, [], 0
    ev, eg = math.exp(-config.dt / config.membrane_tau), math.exp(-config.dt / config.synapse_tau)
    k = config.synapse_tau / (config.synapse_tau - config.membrane_tau) * (eg - ev)
    for t in range(steps):
        frozen, fired = [x > 0 for x in r], []
        for i in range(n):
            if frozen[i]:
                r[i] -= 1
            else:
                v[i], g[i] = config.resting + (v[i] - config.resting) * ev + g[i] * k, g[i] * eg
                if v[i] > config.threshold:
                    fired.append(i)
        for i in due.pop(t, []):
            for target, count in edges.get(i, []):
                visited += signs[i] != 0
                if not frozen[target]:
                    g[target] += config.scale * count * signs[i]
        for i in pulses.get(t, []):
            if not frozen[i]:
                v[i] += amplitude
        for i in fired:
            v[i], g[i], r[i] = config.reset, 0.0, max(0, config.steps(config.refractory) - 1)
            due.setdefault(t + config.steps(config.delay), []).append(i)
            spikes.append((t, i))
    return spikes, visited


@pytest.fixture(scope="module")
def network(spark, sf):
    n, e, _ = streams._small_graph(spark, sf)
    edges = {}
    for r in sorted(e.collect(), key=lambda r: (r.source_index, r.target_index)):
        edges.setdefault(r.source_index, []).append((r.target_index, r.synapse_count))
    return edges, [r.sign for r in sorted(n.collect(), key=lambda r: r.neuron_index)]


@pytest.mark.parametrize("name", ["lif_run", "lif_chunked"])
def test_lif(spark, sf, network, name):
    rows = Q[name](spark, sf).collect()
    stimuli = streams._stimuli(spark).collect()
    for condition in sorted({r.condition for r in stimuli}):
        pulses = {}
        for r in stimuli:
            if r.condition == condition:
                pulses.setdefault(round(r.time_s * 10_000), []).append(r.neuron_index)
        spikes, visited = plain_lif(*network, pulses, 200, 12.0)
        mine = [r for r in rows if r.condition == condition]
        assert sorted((r.step, r.neuron_index) for r in mine if r.step is not None) == spikes
        (total,) = (r for r in mine if r.step is None)
        assert (total.spikes, total.dropped, total.visited) == (len(spikes), 0, visited)


def test_lif_session_stream(spark, sf, network):
    got = {(r.session, r.chunk): r for r in Q["lif_session_stream"](spark, sf).collect()}
    for k in range(4):
        pulses = {50 * chunk + 1: [4 * chunk + k] for chunk in range(6)}
        spikes, _ = plain_lif(*network, pulses, 300, 8.0)
        for chunk in range(6):
            r, inside = got[f"s{k}", chunk], [t for t, _ in spikes if 50 * chunk <= t < 50 * chunk + 50]
            assert (r.step, r.spikes, r.total) == (50 * chunk + 50, len(inside), sum(t < 50 * chunk + 50 for t, _ in spikes))
