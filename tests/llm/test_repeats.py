"""Operator 12 against a plain reading that knows every string's first start."""

import hashlib
import random

import numpy as np
import pytest

from spindrift.llm import repeats


def brute(rows: list[tuple], length: int) -> dict:
    """(id, text) -> sorted (n_removed, spans, kept) of its rows, by a table of all strings."""
    seen, out, done = set(), {}, set()
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    for id_, text in sorted(rows, key=key):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        if (id_, text or "") in done:
            gone[:] = len(data) >= length
        else:
            for s in range(len(data) - length + 1):
                window = data[s : s + length]
                if window in seen:
                    gone[s : s + length] = True
                seen.add(window)
        done.add((id_, text or ""))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        spans = [(int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]
        out.setdefault(id_, []).append((len(data), tuple(spans), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return {k: sorted(v) for k, v in out.items()}


def got(spark, rows: list[tuple], length: int) -> dict:
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")
    out = {}
    for r in repeats.repeats(docs.select("doc_id", "text", "id") if length % 2 else docs, length).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, tuple((s["start"], s["length"]) for s in r.spans), bytes(r.kept)))
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(40) for _ in range(4)] + ["-" * 300, "ab" * 150, "x" * 64 + text(5)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(0, 10))]
        if rows and rng.random() < 0.3:  # a near copy
            old = list(rng.choice(rows)[1] or "")
            for _ in range(rng.randint(0, 3)):
                if old:
                    old[rng.randrange(len(old))] = "#"
            parts = ["".join(old)]
        rows.append((rng.randrange(10 * n) * 1000 + i, "".join(parts)))
    return rows


@pytest.mark.parametrize("length,piece,wide", [(100, 2 << 20, 20_000), (100, 3_000, 3), (31, 700, 2), (64, 5_000, 20_000), (17, 2 << 20, 1)])
def test_every_byte(spark, monkeypatch, length, piece, wide):
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "WIDE", wide)
    rows = corpus(length + piece, 120)
    assert got(spark, rows, length) == brute(rows, length)


def test_frequent_buckets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", 0.0)
    chosen, search = [], repeats._frequent
    monkeypatch.setattr(repeats, "_frequent", lambda *a: chosen.extend(search(*a)) or chosen)
    line = "the same line, sixty-four bytes or so, stands in every document"
    rows = [(i, t[:40] + line + t[40:]) for i, t in corpus(5, 150)]
    assert got(spark, rows, 100) == brute(rows, 100) and chosen


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh \n") for _ in range(150_000))
    rows = [(1, None), (2, ""), (None, long[:500]), (None, long[100:400]), (7, long[:300]), (7, long[:300]), (7, long[50:300] + "é" * 80), (7, long[:300]), (8, "short"), (8, "short"), (9, long), (3, "é" * 200), (4, "a" * 99), (5, "a" * 100), (6, "a" * 101), (6, "a" * 99)]
    assert got(spark, rows, 100) == brute(rows, 100)


def test_empty_table(spark):
    assert got(spark, [], 100) == {}
    assert got(spark, [(1, None)], 100) == {1: [(0, (), b"")]}
    with pytest.raises(ValueError):
        repeats.repeats(spark.createDataFrame([], "doc_id long, text string"), 16)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "q" * 150), ("a", "q" * 120), (None, "q" * 110)], "name string, body string")
    found = {r.name: bytes(r.kept) for r in repeats.repeats(docs, 100, "name", "body").collect()}
    assert found == {"a": b"q", "b": b"", None: b""}  # a starts the string once, at 0; every later start repeats it


def test_query(spark, sf):
    """The whole query on the whole small table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (v[0][0], sum(n for _, n in v[0][1]), len(v[0][1]), hashlib.sha256(v[0][2]).hexdigest()) for k, v in brute(rows, 100).items()}
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op12_repeats(spark, sf).collect()}
    assert found == want and sum(x[1] for x in want.values()) > 10_000


@pytest.mark.parametrize("seed", range(20))
def test_refined(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 2 if seed % 2 else 4, 400).astype(np.uint8)
    length = int(rng.integers(8, 40))
    starts = np.flatnonzero(rng.random(400 - length + 1) < 0.7)
    seen, want = set(), []
    for s in starts:
        w = data[s : s + length].tobytes()
        want.append(w in seen)
        seen.add(w)
    assert repeats.refined(data, starts, length).tolist() == want
