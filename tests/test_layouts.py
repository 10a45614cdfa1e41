"""Compressed blocks, sorted files with offsets, bucketed orientations: against plain sums, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import blocks, graph, normalize, offsets, storage


def graph_of(spark, seed, nodes, edges, hub=True, most=40):
    rng = random.Random(seed)
    pairs = {(rng.randrange(nodes), 3 if hub and rng.random() < 0.3 else rng.randrange(nodes)): rng.choice([1, 2, most]) for _ in range(edges)}
    n = spark.createDataFrame([(i, rng.choice([-1, 0, 1])) for i in range(nodes)], "neuron_index int, sign int")
    e = spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "source_index int, target_index int, synapse_count long")
    return n, e


def same(a, b, *values):
    key = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()))
    return key(a.select(*values)) == key(b.select(*values))


@pytest.mark.parametrize("part,nodes,most", [(1 << 18, 500, 40), (7, 500, 300), (50, 200_000, 70_000), (1 << 18, 70_000, 1 << 33)])
def test_blocks_equal_edges(spark, part, nodes, most):
    n, e = graph_of(spark, part + nodes, nodes, 2_000, most=most)
    packed = storage.materialize(blocks.pack(e, part), "blocks")
    assert packed.agg(F.sum("edges"), F.max("edges")).first()[1] <= part
    assert same(blocks.unpack(packed), e, "source_index", "target_index", "synapse_count")
    events = spark.createDataFrame([(i % nodes, 0.25 * (i % 7)) for i in range(0, 3 * nodes, 5)], "source_index int, activity double")
    once = events.groupBy("source_index").agg(F.sum("activity").alias("activity"))
    assert same(blocks.propagate(n, packed, once), graph.propagate(n, e, once), "neuron_index", "output")
    assert same(blocks.accumulate(n, packed, once), graph.accumulate(n, e, once), "target_index", "amount", "visited")


def test_blocks_beyond_the_bound_and_without_edges(spark, monkeypatch):
    n, e = graph_of(spark, 1, 300, 900)
    packed = blocks.pack(e)
    events = spark.createDataFrame([(i, 1.0) for i in range(300)], "source_index int, activity double")
    monkeypatch.setattr(blocks, "MOST_DRIVES", 100)
    assert same(blocks.accumulate(n, packed, events), graph.accumulate(n, e, events), "target_index", "amount", "visited")
    monkeypatch.undo()
    assert blocks.pack(e.limit(0)).count() == 0
    assert blocks.propagate(n, blocks.pack(e.limit(0)), events).where("output <> 0").count() == 0
    assert blocks.accumulate(n, packed, events.limit(0)).count() == 0


def test_blocks_want_distinct_edges(spark, tmp_path):
    twice = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "source_index int, target_index int, synapse_count long")
    with pytest.raises(Exception, match="distinct"):
        blocks.pack(twice).collect()
    n, e = graph_of(spark, 2, 50, 100)
    blocks.write(e, f"file://{tmp_path}/b")
    assert same(blocks.unpack(blocks.read(spark, f"file://{tmp_path}/b")), e, "source_index", "target_index", "synapse_count")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        blocks.write(e, f"file://{tmp_path}/b")


def test_no_edge_is_shuffled(spark):
    """What meets in the shuffle of a product is a number for each target and row."""
    n, e = graph_of(spark, 3, 2_000, 5_000)
    packed = storage.materialize(blocks.pack(e), "blocks")
    plan = blocks.propagate(n, packed, n.select(F.col("neuron_index").alias("source_index"), F.lit(1.0).alias("activity")))._jdf.queryExecution().executedPlan().toString()
    assert "synapse_count" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("order", [offsets.IN, offsets.OUT])
@pytest.mark.parametrize("partitions", [1, 6])
def test_offsets(spark, tmp_path, order, partitions):
    n, e = graph_of(spark, partitions, 400, 1_500)
    n = n.unionByName(spark.createDataFrame([(i, 0) for i in range(400, 420)], n.schema))  # nodes without edges, at the end
    path = f"file://{tmp_path}/g"
    offsets.write(e, path, order, partitions)
    found = offsets.dense(spark.read.parquet(f"{path}/offsets"), n)
    assert same(found, normalize.offsets(e, n, order[0]), "node", "degree", "start")
    # a node's edges are the rows from its start on
    rows = [(r[order[0]], r[order[1]]) for r in sorted(spark.read.parquet(f"{path}/edges").select("*", "_metadata.file_name", "_metadata.row_index").collect(), key=lambda r: (r.file_name, r.row_index))]
    for r in found.collect():
        assert all(major == r.node for major, _ in rows[r.start : r.start + r.degree]) and (r.start == 0 or rows[r.start - 1][0] < r.node)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        offsets.write(e, path, order, partitions)


def test_order_faults(spark, tmp_path):
    """Faults within a file, between Arrow batches and between files."""
    put = lambda name, rows: spark.createDataFrame(rows, "target_index int, source_index int, synapse_count long").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    told = lambda name: tuple(offsets.order_faults(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")).first())
    put("sorted", [(i // 3, i, 1) for i in range(30)])
    assert told("sorted") == (0, 0, 30)
    put("swapped", [(1, 5, 1), (1, 4, 1), (2, 1, 1)])
    put("repeated", [(1, 5, 1), (1, 5, 1)])
    assert told("swapped") == (1, 0, 3) and told("repeated") == (1, 0, 2)
    with pytest.raises(ValueError, match="1 order faults inside"):
        offsets.require_order(spark, f"{tmp_path}/swapped")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        put("batches", [(i // 3 if i != 10 else 0, i if i != 10 else 0, 1) for i in range(30)])
        assert told("batches") == (0, 1, 30) and told("sorted") == (0, 0, 30)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # files that are in order one by one but not one after another: written by hash of the pair, not by range
    rows = spark.createDataFrame([(i // 3, i, 1) for i in range(60)], "target_index int, source_index int, synapse_count long")
    rows.repartition(4, "source_index").sortWithinPartitions("target_index", "source_index").write.parquet(f"{tmp_path}/crossed")
    inside, borders, n = told("crossed")
    assert inside == 0 and borders > 0 and n == 60
    with pytest.raises(ValueError, match="where they meet"):
        offsets.require_order(spark, f"{tmp_path}/crossed")
    rows.limit(0).write.parquet(f"{tmp_path}/none")
    assert told("none") == (0, 0, 0)


def test_bucketed_joins_shuffle_nothing(spark, tmp_path):
    n, e = graph_of(spark, 9, 300, 1_000)
    offsets.write_buckets(n, e, "layout_test", 4, f"{tmp_path}/tables")
    try:
        found = offsets.Buckets(spark, "layout_test")
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            for made in (found.degrees(), found.through()):
                assert made.count() > 100
                assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
            offsets.write_buckets(n, e, "layout_test", 4, f"{tmp_path}/tables2")
    finally:
        offsets.Buckets(spark, "layout_test").drop("layout_test")
