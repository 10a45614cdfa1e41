"""Tables between the steps of iterative operators, on the storage that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a local folder if driver and executors are one machine (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor costs a re-read.

    The files go by discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, system = _path(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    for made in _open:
        made.append(out)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _path(spark, path)
    return system.exists(where)


_open: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that materialize() writes inside of the block, for discard() after it."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() gave, once all that was made from them is written too. Other tables are left alone."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            where, system = _path(df.sparkSession, path)
            system.delete(where, True)


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df to be broadcast if it has at most so many rows, which are counted up to there; else as it is, for Spark to deal out."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, key: str, groups: int | None = None) -> DataFrame:
    """df in explicit ranges of key, a few for each core or one for each of its groups where these are fewer.

    For groups whose work is long however few bytes they have: adaptive execution would merge them into one task by
    their size, and hashes would deal several to one. groupBy(key) needs no other shuffle.
    """
    groups = df.select(key).distinct().count() if groups is None else groups
    return df.repartitionByRange(min(max(1, groups), max(64, 4 * df.sparkSession.sparkContext.defaultParallelism)), key)


def write_graph(edges: DataFrame, table: str, buckets: int = 64) -> None:
    """Both orientations as bucketed, sorted tables: <table>_in by target, <table>_out by source. Existing tables raise."""
    for suffix, first, second in (("in", "target_index", "source_index"), ("out", "source_index", "target_index")):
        edges.repartition(buckets, first).write.option("compression", "zstd").bucketBy(buckets, first).sortBy(first, second).mode("errorifexists").saveAsTable(f"{table}_{suffix}")


def write_sorted(df: DataFrame, path: str, *order: str, partitions: int | None = None, group_rows: int | None = None) -> None:
    """Globally sorted ZSTD Parquet: ranges over partitions, sorted inside, with row groups of at most group_rows. Existing output raises."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*[F.col(c) for c in order]).write.option("compression", "zstd").mode("errorifexists")
    (out.option("parquet.block.row.count.limit", group_rows) if group_rows else out).parquet(path)


def publish(spark: SparkSession, partial: str, path: str) -> None:
    """A finished folder under its final name, by one rename. Existing output raises, and the partial one stays."""
    where, system = _path(spark, path)
    if system.exists(where):
        raise FileExistsError(path)
    if not system.rename(_path(spark, partial)[0], where):
        raise OSError(f"{partial} could not become {path}")
