"""Sorted edges with compressed-row offsets beside them, checked where files meet, and joins by bucket.

Files hold ranges of (major, minor) pairs, sorted. A node's offset is the place of its first edge: rows of the files before, and the place in its
own file, both of which Spark's metadata columns give, so that offsets are a plain aggregate of one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators import storage

IN, OUT = ("target_index", "source_index"), ("source_index", "target_index")


def write(edges: DataFrame, path: str, order: tuple[str, str] = IN, partitions: int | None = None) -> None:
    """path/edges sorted by order, checked; path/offsets with (node, degree, start) of every node that has edges, node order by range. Existing output raises."""
    spark = edges.sparkSession
    storage.write_sorted(edges, f"{path}/edges", *order, partitions=partitions)
    require_order(spark, f"{path}/edges", order)
    storage.write_sorted(starts(spark.read.parquet(f"{path}/edges"), order[0]), f"{path}/offsets", "node", partitions=partitions)


def _pieces(edges: DataFrame, order: tuple[str, str]) -> DataFrame:
    """(file, first_row, rows, first_major, first_minor, last_major, last_minor, faults) of each stretch of a file that a task reads."""
    schema = "file string, first_row long, rows long, first_major long, first_minor long, last_major long, last_minor long, faults long"
    rows = edges.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), *[F.col(c).cast("long").alias(n) for c, n in zip(order, ("major", "minor"), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("file").dictionary_encode()
            row, major, minor = (batch.column(c).to_numpy() for c in ("row", "major", "minor"))
            index = files.indices.to_numpy()
            new = np.ones(len(row), bool)
            new[1:] = (index[1:] != index[:-1]) | (row[1:] != row[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            fault = np.zeros(len(row), np.int64)
            fault[1:] = ~new[1:] & ((major[1:] < major[:-1]) | (major[1:] == major[:-1]) & (minor[1:] <= minor[:-1]))
            if len(first):
                yield pa.RecordBatch.from_arrays([files.dictionary.take(files.indices.take(pa.array(first))), *[pa.array(x) for x in (row[first], last - first + 1, major[first], minor[first], major[last], minor[last], np.add.reduceat(fault, first))]], names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def order_faults(edges: DataFrame, order: tuple[str, str] = IN) -> DataFrame:
    """One row: inside (faults within stretches of a file), borders (faults where stretches or files meet, files by name), rows.

    Strictly ascending pairs have none; a repeated pair is a fault. Stretches are Arrow batches: some 10,000 rows make one row of the last window.
    """
    pieces = _pieces(edges, order)
    # files come first to last: inside of a file the borders are looked at by file, between files by each file's ends
    inside = Window.partitionBy("file").orderBy("first_row")
    broken = lambda w: (F.col("first_major") < F.lag("last_major").over(w)) | (F.col("first_major") == F.lag("last_major").over(w)) & (F.col("first_minor") <= F.lag("last_minor").over(w))
    per = pieces.withColumn("broken", F.coalesce(broken(inside), F.lit(False)).cast("long")).groupBy("file").agg(
        F.sum("faults").alias("inside"), F.sum("broken").alias("borders"), F.sum("rows").alias("rows"),
        *[F.min_by(c, "first_row").alias(c) for c in ("first_major", "first_minor")], *[F.max_by(c, "first_row").alias(c) for c in ("last_major", "last_minor")],
    )
    files = Window.orderBy("file")  # a row for each file
    per = per.withColumn("between", F.coalesce(broken(files), F.lit(False)).cast("long"))
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in (("inside", F.col("inside")), ("borders", F.col("borders") + F.col("between")), ("rows", F.col("rows")))])


def require_order(spark: SparkSession, path: str, order: tuple[str, str] = IN) -> None:
    """Raises if the edges at path aren't in strict order, across files too."""
    found = order_faults(spark.read.parquet(path), order).first()
    if found.inside or found.borders:
        raise ValueError(f"{path}: {found.inside} order faults inside of stretches, {found.borders} where they meet")


def starts(edges: DataFrame, major: str = "target_index") -> DataFrame:
    """(node, degree, start) of the nodes that have edges, out of sorted files: start is the rank of a node's first edge."""
    rows = edges.select(F.col(major).alias("node"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each file
    first = rows.groupBy("node", "file").agg(F.count("*").alias("n"), F.min("row").alias("row")).join(bases, "file")
    return first.groupBy("node").agg(F.sum("n").alias("degree"), F.min(F.col("base") + F.col("row")).alias("start"))


def dense(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, start) of every node: one without edges starts where the next one that has some does; after the last, at the number of edges.

    The running sum goes over ranges of nodes first (normalize.offsets); here starts are known, so a node without edges takes those before it.
    """
    from spindrift.operators import normalize

    all_ = nodes.select(F.col("neuron_index").alias("node")).join(found, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), (F.col("start") + F.col("degree")).alias("end"))
    _, number = normalize.key_ranges(nodes.select(F.col("neuron_index").alias("node")), "node")
    ranged = all_.withColumn("__range", number.cast("int"))
    over = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("__range").agg(F.max("end").alias("last")).withColumn("__before", F.coalesce(F.max("last").over(over), F.lit(0))).drop("last")  # a row for each range
    inside = Window.partitionBy("__range").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(ends), "__range").select("node", "degree", F.coalesce(F.max("end").over(inside), F.col("__before")).cast("long").alias("start"))


def write_buckets(neurons: DataFrame, edges: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """<table>_nodes by neuron_index, <table>_in by target and <table>_out by source, all in so many buckets, sorted. Existing tables raise."""
    for suffix, df, keys in (("nodes", neurons, ("neuron_index",)), ("in", edges, IN), ("out", edges, OUT)):
        writer = df.repartition(buckets, keys[0]).write.option("compression", "zstd").bucketBy(buckets, keys[0]).sortBy(*keys).mode("errorifexists")
        (writer.option("path", f"{path}/{suffix}") if path else writer).saveAsTable(f"{table}_{suffix}")


class Buckets:
    """Both orientations of a bucketed graph. Joins on a node go bucket by bucket: no edge is shuffled."""

    def __init__(self, spark: SparkSession, table: str):
        self.nodes, self.incoming, self.outgoing = (spark.table(f"{table}_{x}") for x in ("nodes", "in", "out"))

    def degrees(self) -> DataFrame:
        """(neuron_index, in_degree, in_contacts, out_degree, out_contacts) of every node."""
        sums = lambda df, key, name: df.groupBy(F.col(key).alias("neuron_index")).agg(F.count("*").alias(f"{name}_degree"), F.sum("synapse_count").alias(f"{name}_contacts"))
        both = self.nodes.select("neuron_index").join(sums(self.incoming, "target_index", "in"), "neuron_index", "left").join(sums(self.outgoing, "source_index", "out"), "neuron_index", "left")
        return both.fillna(0)

    def through(self) -> DataFrame:
        """(neuron_index, paths): how many two-edge paths lead through each node, out of both orientations."""
        a = self.incoming.groupBy(F.col("target_index").alias("neuron_index")).agg(F.count("*").alias("a"))
        b = self.outgoing.groupBy(F.col("source_index").alias("neuron_index")).agg(F.count("*").alias("b"))
        return a.join(b, "neuron_index").select("neuron_index", (F.col("a") * F.col("b")).alias("paths"))

    def drop(self, table: str) -> None:
        for x in ("nodes", "in", "out"):
            self.nodes.sparkSession.sql(f"DROP TABLE IF EXISTS {table}_{x}")
