"""The automata and the model of ordinary text are learned from every document and every credential."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import secrets


def test_all_documents_and_credentials_count(spark):
    docs = spark.range(24_000).select("id", F.concat(F.lit("plain words, token="), F.sha1(F.col("id").cast("string")), F.lit(" zq")).alias("text")).withColumnRenamed("id", "doc_id")
    scanner = secrets.fit(docs)
    hexes = scanner.automata["hex"]
    assert sum(hexes.ends) == 24_000 and sum(map(sum, (c.values() for c in hexes.count))) == 24_000 * 40
    seen = Counter()
    for text in ("plain words, ", " zq"):
        seen.update(secrets.pairs_of(text))
    n = {}
    real = secrets.Scanner
    try:
        secrets.Scanner = lambda found, pairs: n.update(pairs)
        secrets.fit(docs)
    finally:
        secrets.Scanner = real
    assert n == {k: v * 24_000 for k, v in seen.items()}
    pick = lambda k: "".join(random.Random(k).choices("0123456789abcdef", k=40))
    assert all(scanner.is_format(pick(k)) for k in range(50)) and not any(scanner.is_format(x) for x in ("words", "2024", "plain-text"))


def test_pairs_by_array():
    texts = ["", "a", "über token=abc123x/y z", "x" * 30 + " password: qwertz9 end=", "AKIA" + "Q7" * 10 + "-b c", "\n\n é-é", "0123456789abcdef0123456789-go on"]
    got = secrets.pair_counts(texts, [secrets.base_spans(t) for t in texts])
    want = Counter()
    for t in texts:
        want.update(secrets.pairs_of(t))
    width = len(secrets._SYMBOLS)
    assert {secrets._SYMBOLS[i // width] + secrets._SYMBOLS[i % width]: int(got[i]) for i in np.flatnonzero(got)} == dict(want)


def test_counts_of_a_cut_tree_are_all_strings():
    rng = random.Random(3)
    strings = ["Q7" + "".join(rng.choices("ABCDEF", k=rng.randint(3, 12))) for _ in range(500)]
    tree = {p: Counter(s[len(p) : len(p) + 1] for s in strings if s.startswith(p)) for p in {s[:i] for s in strings for i in range(4)}}
    made, seen = secrets.Automaton.of_prefixes(tree, Counter(map(len, strings))), Counter()
    for s in strings:
        made.tally(s, seen)
    made.recount(seen)
    assert sum(made.ends) == 500 and sum(made.total) == 500 + sum(map(len, strings))
    assert made.bits("Q7ABCDEF") < made.bits("ABCDEFQ7")
