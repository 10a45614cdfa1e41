"""Credentials that no fixed pattern matches: recall and precision on planted ones, and spans against a plain reading."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spindrift.llm import queries, secrets

RUN = r"[A-Za-z0-9+/_.=-]+"


def plain_formats(scanner: secrets.Scanner, run: str) -> list[tuple[int, int]]:
    """All stretches between separators, each scored as a whole; from the left, the one with the most evidence."""
    def evidence(s, e):
        ordinary = sum(scanner.ordinary.table[a][b] for a, b in zip((run[s - 1] if s else " ") + run[s:e], run[s:e]))
        return max((ordinary - a.bits(run[s:e]) for a in scanner.automata.values() if not given_up(a, s, e)), default=-math.inf)

    def given_up(a, s, e):
        state, lead, best = 0, 0.0, 0.0
        for at in range(s, e):
            state, bits = a.step(state, run[at])
            lead += scanner.ordinary.table[run[at - 1] if at else " "][run[at]] - bits
            best = max(best, lead)
            if lead < best - scanner.drop:
                return True
        return False

    pieces = [m.span() for m in re.finditer(r"[^=/.]+", run)]
    starts = sorted({0, *(s for s, _ in pieces)})
    stops = sorted({len(run), *(e for _, e in pieces), *(s + len(run[s:e].rstrip("-")) for s, e in pieces)})
    found, done = [], 0
    for s in starts:
        scored = [(evidence(s, e), e) for e in stops if e > s] if s >= done else []
        if scored and max(scored)[0] >= scanner.evidence:
            done = max(scored)[1]
            if not re.fullmatch(r"[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}", run[s:done]):
                found.append((s, done))
    return found


@pytest.fixture(scope="module")
def planted(spark, sf):
    """3,000 documents, a tenth of them with a credential of some format in their middle, the others with a harmless look-alike."""
    rng = random.Random(6)
    pick = lambda symbols, n: "".join(rng.choices(symbols, k=n))
    alnum = secrets._ALNUM
    bad = [lambda: "ghp_" + pick(alnum, 36), lambda: f"xoxb-{pick('0123456789', 12)}-{pick('0123456789', 12)}-{pick(alnum, 24)}", lambda: "AIza" + pick(alnum + "_-", 35), lambda: pick("0123456789ABCDEF", 40), lambda: "sk_live_" + pick(alnum, 24), lambda: "Bearer/" + pick(alnum, 32)]
    good = [lambda: pick("0123456789", rng.randint(4, 16)), lambda: "2024-05-06T10:11:12.123", lambda: "http://www.example.org/some/path/of-words.html", lambda: "version-1.2.3-beta", lambda: "-" * 30, lambda: "state-of-the-art/and.so_on=yes"]
    docs = []
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    for i in range(3000):
        words = (texts[i % len(texts)] or "").split(" ")[:400]
        kind = rng.randrange(6) if i % 10 == 0 else 6 + rng.randrange(6)
        value = (bad[kind] if kind < 6 else good[kind - 6])()
        docs.append((i, " ".join([*words[: len(words) // 2], "see", value, "there", *words[len(words) // 2 :]]), value, kind < 6))
    return spark.createDataFrame(docs, "doc_id long, text string, value string, secret boolean")


def test_recall_and_precision(planted):
    scanner = secrets.fit(planted.select("doc_id", "text"))
    found = secrets.scan(planted, scanner).collect()
    caught = wrong = 0
    for r in found:
        spans = [r.text[s.start : s.end] for s in r.secret_spans if s.kind == secrets.FORMAT]
        if r.secret:
            caught += any(r.value.removeprefix("Bearer/") in s or s in r.value and len(s) > 20 for s in spans)
        wrong += sum(s not in r.value or not r.secret for s in spans)
    n = sum(r.secret for r in found)
    assert n > 50 and caught >= 0.97 * n and wrong <= 0.02 * n


def test_spans_against_a_plain_reading(spark, sf, planted):
    scanner = secrets.fit(planted.select("doc_id", "text"))
    for r in planted.collect():
        base = secrets.base_spans(r.text)
        want = list(base)
        for m in re.finditer(RUN, r.text):
            if len(m[0]) < 400:
                want += [(m.start() + s, 3, m.start() + e) for s, e in plain_formats(scanner, m[0]) if not any(a < m.start() + e and m.start() + s < b for a, _, b in base)]
        assert scanner.scan(r.text) == sorted(want)


def test_query_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    scanner = secrets.fit(docs)
    want = {r.doc_id: ",".join(f"{[*secrets.KINDS, secrets.FORMAT][k]}:{s}:{e}" for s, k, e in scanner.scan(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.spans for r in queries.queries()["op8_secrets"](spark, sf).collect()} == want


def test_lengths_generalise():
    rng = random.Random(7)
    pick = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    plain = "and so the words of a plain text go on and on, 1999 or 2024 for example "
    scanner = secrets.Scanner({"hex": {pick(40): 1 for _ in range(300)}}, secrets.pairs_of(plain * 50))
    for n in (30, 39, 41, 64):
        assert all(scanner.is_format(pick(n)) for _ in range(50)), n
    assert not any(scanner.is_format(x) for x in ("", "a", "words", "and", "2024", "plain-text"))


def test_long_texts_are_linear():
    scanner = secrets.Scanner({"a": {"Q7" + "".join(random.Random(i).choices("ABCDEFGH0123", k=20)): 1 for i in range(100)}}, secrets.pairs_of("plain words " * 100))
    for text in ("token=" + "a1" * 4 + " " + "x/", "a/" * 2, "password=abcdef12 plain ", "0123456789abcdef0123456789 "):
        took = []
        for n in (20_000, 80_000):
            start = time.time()
            scanner.scan(text * n)
            took.append(time.time() - start)
        assert took[1] < 12 * took[0] + 1, text
    start = time.time()
    scanner.scan("x" * 5_000_000)
    assert time.time() - start < 20


def test_null_ids_are_drawn_apart(spark, monkeypatch):
    monkeypatch.setattr(secrets, "Scanner", lambda labelled, pairs: labelled)  # what would be learned from
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("words and token="), F.sha1(F.col("id").cast("string"))).alias("text"))
    assert 50 < len(secrets.fit(docs, sample_docs=100, max_labelled=1000)["hex"]) < 200
