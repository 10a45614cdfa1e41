"""Connected components by alternating star operations on edge tables; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import discard, materialize


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Each round hangs every node's larger neighbours under its smallest neighbour (large star), then its
    smaller ones (small star). Rounds: logarithmic in the diameter. A round's edges, never more than the
    edges of the input and their nodes, are written to the shared folder, so no lineage builds up, and the
    last round's are dropped. edges is read once, before this returns. Self
    loops and repeated edges do no harm; null ends are ignored; an empty table gives an empty table.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(limit):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialize(small, "edges")
        discard(last)
    else:
        raise RuntimeError(f"components: no fixed point in {limit} rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
