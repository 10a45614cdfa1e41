"""Links near the wanted cosine: recall against every pair, with a crowded group of near copies, a hot label and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import embeddings


def at_cosine(rng, v, cosine):
    """A unit vector at the cosine to v."""
    away = rng.standard_normal(len(v))
    away -= away @ v * v
    return cosine * v + np.sqrt(1 - cosine * cosine) * away / np.linalg.norm(away)


def unit(rng, d):
    v = rng.standard_normal(d)
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def planted():
    """(vec_id, vector, label): 700 pairs from 0.975 to 0.99, 400 near copies of one vector, 400 exact ones, 1,500 lone vectors."""
    rng = np.random.default_rng(3)
    rows = []
    for cosine in np.linspace(0.975, 0.99, 700):
        v = unit(rng, 64)
        rows += [(v, 0), (at_cosine(rng, v, cosine) * rng.uniform(0.1, 9), 0)]
    hub = unit(rng, 64)
    rows += [(at_cosine(rng, hub, 0.9925), 0) for _ in range(400)] + [(hub, 1)] * 400
    rows += [(unit(rng, 64), int(rng.integers(2))) for _ in range(1500)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k][0].astype(float).tolist(), rows[k][1]) for i, k in enumerate(order)]


def brute(rows):
    links = {}
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.98
        links |= {r[0]: n for r, n in zip(own, near.sum(1) - 1, strict=True)}
    return links


def test_recall_near_the_cosine(spark, monkeypatch, planted):
    monkeypatch.setattr(embeddings, "CHUNK", 100)
    want = brute(planted)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(planted, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] <= n for i, n in want.items())  # none below the cosine
    assert sum(want.values()) > 50_000 and sum(got.values()) >= 0.995 * sum(want.values())
    pairs = [i for i, n in want.items() if n == 1]
    assert len(pairs) > 800 and sum(got[i] for i in pairs) >= 0.99 * len(pairs)


@pytest.mark.parametrize("vectors", [10, 5000, 10**6])
def test_pairs_at_the_cosine_meet_and_pass_the_count(vectors):
    rng = np.random.default_rng(4)
    lines = embeddings.Lines(48, 0.98, vectors)
    n = 4000
    a = np.stack([unit(rng, 48) for _ in range(n)])
    b = np.stack([at_cosine(rng, v, 0.98) for v in a])
    (ca, sa, oa, ba), (cb, sb, ob, bb) = lines.places(a), lines.places(b)
    together = (ca == cb) & (np.abs(sa - sb) <= lines.reach)
    assert together.any(1).mean() > 0.997
    # whoever is together shares a stretch, at home or as a guest
    assert (~together | (oa == ob) | (oa == bb) | (ba == ob)).all()
    assert (lines.counts(a @ lines.lines[:, : lines.counted], np.arange(n), np.arange(n)) == lines.counted).all()
    both = np.concatenate([a, b]) @ lines.lines[:, : lines.counted]
    assert (lines.counts(both, np.arange(n), np.arange(n) + n) >= lines.count).mean() > 0.999
    # by chance few meet, however many there are
    other = np.roll(np.arange(n), 1)
    chance = ((ca == ca[other]) & (np.abs(sa - sa[other]) <= lines.reach)).any(1).mean()
    assert chance * vectors < 50 * lines.groups


def test_lines_follow_the_vectors():
    sizes = [embeddings.Lines(8, 0.98, 10**k) for k in range(1, 10)]
    assert [x.per_group for x in sizes] == sorted(x.per_group for x in sizes) and sizes[-1].groups < 200
    assert embeddings.Lines(8, 0.9, 10**5).groups < 500
    with pytest.raises(ValueError):
        embeddings.Lines(8, 0.7, 10**5)


def test_windows():
    rng = np.random.default_rng(5)
    keys, spots = rng.integers(0, 9, 400), rng.normal(0, 1, 400)
    order = np.lexsort((spots, keys))
    keys, spots = keys[order], spots[order]
    got = {(int(a), int(b)) for x, y in embeddings._windows(keys, spots, 0.2) for a, b in zip(x, y, strict=True)}
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if keys[a] == keys[b] and spots[b] - spots[a] <= 0.2}
    assert want <= got and all(keys[a] == keys[b] and spots[b] - spots[a] <= 0.201 for a, b in got)
    assert not list(embeddings._windows(np.empty(0, np.int64), np.empty(0), 0.2))


def test_ties_nulls_and_repeats(spark):
    v, w = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [(3, v, 1), (1, w, 1), (2, v, 1), (2, v, 1), (None, v, 1), (4, v, None), (5, None, 1), (6, [float("inf"), 1.0, 1.0], 1), (7, [-0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)


def test_ids_that_name_several_vectors(spark):
    """Links and classes are of vectors: against every pair, with ids that repeat within and across labels."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 24))
    rows = []
    for i in range(260):
        v = base[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.0, 0.02, 0.05, 0.4])
        rows.append((int(rng.integers(0, 60)), [float(np.float32(x)) for x in v], str(rng.choice(["a", "b"]))))
    rows += rows[:9]  # whole rows again
    e1, e2 = [1.0] + [0.0] * 23, [0.0, 1.0] + [0.0] * 22
    near = lambda e: [x + 0.001 for x in e]
    rows += [(1001, e1, "c"), (1001, e2, "c"), (1002, near(e1), "c"), (1003, near(e1), "c"), (1004, near(e2), "c"), (1001, near(e2), "d")]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    np.fill_diagonal(linked, False)
    assert np.abs(x @ x.T - 0.98).min() > 1e-9
    root = np.array([r[0] for r in rows])
    for _ in range(len(rows)):
        new = np.minimum(root, np.where(linked, root[None], 1 << 40).min(1))
        if (new == root).all():
            break
        root = new
    want = sorted((r[0], int(linked[i].sum()), int(root[i]), bool(r[0] == root[i])) for i, r in enumerate(rows))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(docs).collect()) == want
    assert [w for w in want if w[0] == 1001] == [(1001, 0, 1001, True), (1001, 1, 1001, True), (1001, 2, 1001, True)]
