"""Documents and streams that leave the engine: versioned JSON, run manifests, fan-out of micro-batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document with schema_version 1, published whole by Spark's committer; existing output raises."""
    spark.createDataFrame([(json.dumps({"schema_version": 1} | document, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    found = json.loads("".join(r.value for r in spark.read.text(path).collect()))  # one document
    if found.get("schema_version") != 1:
        raise ValueError(f"schema_version {found.get('schema_version')} is unknown")
    return found


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines; 64-bit ids (columns that end in _id) as text, so that readers with doubles keep them whole."""
    safe = df.select(*[F.col(f.name).cast("string").alias(f.name) if f.name.endswith("_id") and f.dataType.typeName() == "long" else F.col(f.name) for f in df.schema])
    safe.write.mode("errorifexists").json(path)


def run_manifest(spark: SparkSession, path: str, **facts) -> None:
    """What a run was: session settings that change results, and the caller's facts."""
    settings = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions")}
    write_document(spark, {"spark": spark.version, "settings": settings} | facts, path)


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], log: str, mode: str = "append"):
    """Every micro-batch to each sink, computed once; a sink that fails fails the batch, which then comes again with its number."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(deliver).trigger(availableNow=True).start()
