"""Session settings that the engine is designed for; a cluster's own settings win where they are set."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "spindrift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC. Underscores in names stand for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
