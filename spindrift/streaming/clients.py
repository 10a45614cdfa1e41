"""Frames to clients that come when they can: a log of epochs, and a place in it for each client.

A publisher writes each micro-batch as an epoch, once. A client's poll gives it the newest frame of each session since its
last one, and how many older ones gave way: whoever polls after each epoch gets every frame, whoever stalls gets
the newest, as from a queue with one slot. No client's pace or failure touches the publisher or another client.
Places are kept in a table, a partition for each client, and move only after the client's sink has returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import storage

_PLACE = "epoch long, frames long, dropped long, client string"


def put(frames: DataFrame, epoch: int, log: str) -> None:
    """Frames as an epoch of the log; an epoch that comes again, as after a restart, replaces itself."""
    frames.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(log)


def publish(stream: DataFrame, log: str, checkpoint: str, once: bool = True):
    """The running query that writes each micro-batch of a stream as an epoch; once: up to the end of what there is."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda frames, epoch: put(frames, epoch, log))
    return (writer.trigger(availableNow=True) if once else writer).start()


def place(spark: SparkSession, places: str, client: str) -> tuple[int, int, int]:
    """(last epoch, frames given, frames that gave way) of a client; (-1, 0, 0) of a new one."""
    if not storage.exists(spark, places):
        return -1, 0, 0
    found = spark.read.schema(_PLACE).parquet(places).where(F.col("client") == client).first()
    return (found.epoch, found.frames, found.dropped) if found else (-1, 0, 0)


def waiting(frames: DataFrame, after: int, session: str, order: list[str]) -> DataFrame:
    """The newest frame of each session in epochs after the given one, with dropped: how many older ones gave way."""
    rest = [c for c in frames.columns if c not in (session, "epoch", *order)]
    newest = F.max(F.struct("epoch", *order, *rest)).alias("newest")
    out = frames.where(F.col("epoch") > after).groupBy(session).agg(newest, (F.count("*") - 1).alias("dropped"))
    return out.select(session, *[F.col(f"newest.{c}").alias(c) for c in ("epoch", *order, *rest)], "dropped")


def poll(spark: SparkSession, log: str, places: str, client: str, session: str, order: list[str], sink: Callable[[DataFrame], None]) -> tuple[int, int]:
    """Give a client what waits for it; (frames, dropped) of this poll. If the sink raises, the client's place stays and the next poll gives more.

    order: columns whose largest value is the newest frame of an epoch.
    """
    if not storage.exists(spark, log):
        return 0, 0
    frames = spark.read.parquet(log)
    epoch, given, dropped = place(spark, places, client)
    newest = frames.where(F.col("epoch") > epoch).agg(F.max("epoch")).first()[0]
    if newest is None:
        return 0, 0
    found = waiting(frames.where(F.col("epoch") <= newest), epoch, session, order)  # whatever is published meanwhile waits for the next poll
    sink(found)
    n, gone = found.agg(F.count("*"), F.coalesce(F.sum("dropped"), F.lit(0))).first()
    moved = spark.createDataFrame([(newest, given + n, dropped + gone, client)], _PLACE)
    moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("client").parquet(places)
    return n, gone


def poll_all(spark: SparkSession, log: str, places: str, session: str, order: list[str], sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Poll for several clients; what became of each: `ok`, or the error of its sink, which is no other client's concern."""
    out = {}
    for client, sink in sinks.items():
        try:
            poll(spark, log, places, client, session, order, sink)
            out[client] = "ok"
        except Exception as error:  # a sink is the client's own code
            out[client] = f"{type(error).__name__}: {error}"
    return out
