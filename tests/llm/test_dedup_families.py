"""Large families: short texts that share a frequent shingle and link with nobody, and near copies over several chunks."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spindrift.llm import dedup


def work(texts, width=2, center=0):
    table = pa.table({"member": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "chunks": pa.array([1] * len(texts), pa.int32())})
    return dedup._within_chunk(width, 80)((pa.scalar(center, pa.int64()), pa.scalar(0)), table)


def test_texts_that_share_a_shingle_dont_meet():
    took = []
    for n in (10_000, 40_000):
        start = time.time()
        assert work([f"hello there u{i}" for i in range(n)]).num_rows == 0
        took.append(time.time() - start)
    assert took[1] < 8 * took[0] + 1


def test_prefix_filter_is_exact():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    for percent in (50, 80, 95, 100):
        sets = [np.unique([rng.randrange(10**6) if rng.random() < 0.1 else words.index(w) for w in rng.choices(words, k=rng.randint(1, 14))]).astype(np.uint64) for _ in range(150)]
        sets += [np.append(s, np.uint64(10**7 + i)) for i, s in enumerate(sets[:40])]
        block = dedup._Block(sets, percent)
        for i in range(len(sets)):
            want = [j for j in range(len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
            assert block.links(i).tolist() == want and block.near(i).tolist() == want


def test_many_short_texts(spark):
    """200,000 texts with one shingle in common, and a few real copies among them."""
    base = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("hello there u"), F.when(F.col("id") < 199_990, F.col("id")).otherwise(F.lit(7))).alias("text"))
    out = dedup.near_duplicates(base, width=2)
    assert out.where("not kept").count() == 10 and {r.component_id for r in out.where("not kept").collect()} == {7}


def test_families_of_several_chunks(spark, monkeypatch):
    """Loose members over chunks: pairs of near copies inside one large family of texts that are otherwise apart."""
    monkeypatch.setattr(dedup, "CHUNK", 2_000)
    rng = random.Random(2)
    rows = []
    for i in range(400):
        own = " ".join(f"x{i}y{k}" for k in range(12))
        rows += [(len(rows), f"a b c d e f {own}"), (len(rows) + 1, f"a b c d e f {own} z{rng.randrange(9)}")]
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1, bands=64, rows=1).collect()}
    assert got == {i: i - i % 2 for i in range(len(rows))}
