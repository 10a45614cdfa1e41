"""op2_mixing row by row against a plain reading of the plan; mixed() against draws(); clashing names and repeated rows."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixing, queries


def plain_taken(rows, targets, seed=20, block_words=50_000, most=2):
    """Words taken of each row: blocks by hash, in keyed order up to the quota of each pass, the last one's rows in keyed order."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    taken = Counter()
    for source, own in by_source.items():
        size = sum(r.size_ for r in own)
        n = max(1, math.ceil(size / block_words))
        blocks = defaultdict(list)
        for r in own:
            blocks[r.place % n].append(r)
        order = sorted(blocks, key=lambda b: (next(k for k in own[0].orders if k.block == b).rank, b)) if n > 1 else [0]
        for p in range(most):
            left = max(0, min(size, math.floor(targets[source]) - p * size))
            for b in order:
                for r in sorted(blocks[b], key=lambda r: (r.inner, r.doc_id, r.size_, r.hash)):
                    part = min(r.size_, left)
                    taken[r.doc_id] += part
                    left -= part
    return taken


def test_every_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.queries()["op2_mixing"](spark, sf).collect()}
    size = F.udf(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), "long")(F.col("text"))
    keys = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(400).cast("long")), lambda b: F.struct(b.alias("block"), F.xxhash64(F.lit(21), F.col("source"), b).alias("rank")))
    rows = docs.withColumn("size_", size).withColumn("hash", F.xxhash64("text"))
    rows = rows.select("doc_id", "source", "size_", "hash", F.xxhash64(F.lit(20), "doc_id", "size_", "hash").alias("place"), F.xxhash64(F.lit(22), "doc_id").alias("inner"), keys.alias("orders")).collect()
    want = plain_taken(rows, {r.source: got[r.doc_id].target for r in rows})
    assert {i: r.taken for i, r in got.items()} == {i: want[i] for i in text}


@pytest.mark.parametrize(("block_words", "broadcast"), [(50_000, 10**6), (60, 10**6), (60, 0)])
def test_mixed_is_what_is_drawn(spark, sf, monkeypatch, block_words, broadcast):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", broadcast)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 2000").limit(60)
    docs = docs.unionByName(docs.limit(20)).withColumn("mix_position", F.lit("clash")).withColumn("size", F.lit("own")).withColumn("before", F.lit("own")).cache()
    drawn = mixing.draws(docs, block_words=block_words).collect()
    want = Counter()
    for r in drawn:
        want[r.id] += sum(d.words * 2 >= r["size"] for d in r.draws)
    out = mixing.mixed(docs, block_words=block_words)
    assert out.columns == [c for c in docs.columns if c != "mix_position"] + ["mix_shard", "mix_position"]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == +want and all(r["size"] == r.before == "own" for r in rows)
    assert sorted(str(d.shard) for r in drawn for d in r.draws if d.words * 2 >= r["size"]) == sorted(str(r.mix_shard) for r in rows)


def test_null_ids_lie_apart(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    plan = mixing.planned(mixing.sized(docs), block_words=100)
    assert plan.placed(mixing.sized(docs)).groupBy("block").count().agg(F.max("count")).first()[0] < 100
