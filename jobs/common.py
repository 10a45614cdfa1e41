"""What the jobs share: configs, logs, and the folder of a registered call."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.operators import storage

log = logging.getLogger("spindrift.jobs")


def config(spark: SparkSession, path: str, required: tuple[str, ...]) -> dict:
    """A JSON config, read on the driver by Spark's file systems: the driver's own file or a remote one. Missing keys raise."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        found = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    missing = [k for k in required if k not in found]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found


def twice(name: str, run: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query of a job: it runs twice into one new folder; the output as it stands then."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        run(spark, sf_dir, out)
        return run(spark, sf_dir, out)

    return call


def start(app: str) -> SparkSession:
    """The session of a command line; jobs themselves take one."""
    from spindrift.session import session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return session(app)
