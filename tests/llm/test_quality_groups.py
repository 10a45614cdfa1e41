"""Verdicts of op6 in groups of their own against a plain minimum-covariance-determinant estimate; ties and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import quality
from test_llm import brute_statistics


def plain_distances(points: np.ndarray, central: float = 0.75, steps: int = 5) -> np.ndarray:
    """Concentration steps on the points themselves: the h nearest, their mean and covariance, again."""
    floor = np.array(quality.FLOOR)
    spread = (np.quantile(points, 0.75, 0) - np.quantile(points, 0.25, 0)) / 1.349
    mean, cov = np.median(points, 0), np.diag(spread**2 + floor**2)
    d = lambda: np.einsum("ni,ij,nj->n", points - mean, np.linalg.inv(cov), points - mean)
    for _ in range(steps):
        near = points[np.argsort(d(), kind="stable")[: math.ceil(central * len(points))]]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) + np.diag(floor**2)
    return d() / max(1.0, np.median(d()) / quality.CHI2_MEDIAN_4)


@pytest.fixture(scope="module")
def documents():
    """Two languages x two sources with 250 texts each; sources differ in word length and symbols; one text in 12 is far out."""
    rng = random.Random(9)
    rows = []
    for lang in ("aa", "bb"):
        for source in ("s1", "s2", None):
            letters = 4 if lang == "aa" else 9
            for i in range(250 if source else 20):
                words = ["".join(rng.choices("abcdefghij", k=max(1, round(rng.gauss(letters, 1.5))))) for _ in range(rng.randint(60, 120))]
                if source == "s2":  # a source of many symbols, which is ordinary there
                    words = [w + "#" if rng.random() < 0.3 else w for w in words]
                text = " ".join(words)
                kind = rng.randrange(24)
                if kind == 0:
                    text = " ".join(w + "$%&" * 3 for w in words)
                elif kind == 1:
                    text = " ".join("".join(rng.choices("xyz", k=60)) for _ in words)
                rows.append((len(rows), text, lang, source, kind < 2))
    return rows


def test_verdicts_in_groups(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, odd boolean").withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in quality.judge(docs, least_group=200).collect()}
    points = {}
    for i, text, *_ in documents:
        n, chars, symbols, dup, rep = brute_statistics(text)
        points[i] = [math.log(max(chars, 1) / n), math.sqrt(symbols / n), math.sqrt(dup / n), math.sqrt(rep / n)]
    sizes = {g: sum((r[2], r[3]) == g for r in documents) for g in {(r[2], r[3]) for r in documents}}
    checked = 0
    for (lang, source), n in sizes.items():
        # small groups are judged among all of their language
        among = [r[0] for r in documents if r[2] == lang and (n < 200 or r[3] == source)]
        d = dict(zip(among, plain_distances(np.array([points[i] for i in among])), strict=True))
        for r in documents:
            if (r[2], r[3]) == (lang, source):
                want, have = d[r[0]], got[r[0]].distance
                assert have == pytest.approx(want, rel=0.12, abs=0.5), (r[0], want, have)
                if not 50 < want < 72:
                    assert got[r[0]].kept == (want <= 60)
                    checked += 1
    assert checked > 900
    odd = [got[r[0]].kept for r in documents if r[4]]
    plain = [got[r[0]].kept for r in documents if not r[4]]
    assert sum(odd) < 0.1 * len(odd) and sum(plain) > 0.99 * len(plain)


def test_ties_and_equal_texts(spark):
    """Groups without any spread: equal points all stay, one that differs goes."""
    same, other = "word " * 3 + " ".join(f"w{i}" for i in range(60)), " ".join("#" * 9 + f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, same, "x", "s") for i in range(300)] + [(300, other, "x", "s"), (301, None, None, None), (302, "", "x", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept for i in range(300)) and not got[300].kept and got[301].base_failed and got[302].base_failed
    assert {got[i].distance for i in range(300)} == {got[0].distance}


def test_shuffled_estimates_are_the_same(spark, documents, monkeypatch):
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, odd boolean")
    one = {r.doc_id: r.distance for r in quality.judge(docs).collect()}
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    two = {r.doc_id: r.distance for r in quality.judge(docs).collect()}
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i]) for i in one)
