"""Goals that people type in sessions, from files as they arrive to a deduplicated, partitioned log.

    python -m jobs.goal_log --input /data/sessions --output /data/goals [--config jobs/goal_log.json]

A session's turns arrive as files, some of them twice. The panel matches goals literally, once they are normalized
(case folded, white space collapsed). The job takes the files that its checkpoint hasn't seen, to their end, and writes

* turns/ (partitioned by batch and author): session, step, goal, goal_id (SHA-256 of the goal), chars, words, of each (session, step) once:
  as in the batch that brought it first and, within one, of the author and goal that sort first;
* rejected/ (partitioned by batch and reason): turns without a session, a step, a known author, or any text, how often each.

A batch writes its own partitions and replaces them if it is repeated, so a run that dies is made good by the next one.
Batch 0, the first of a new checkpoint, replaces all of the output. A rerun without new files changes nothing.
What an earlier batch has is found by a join on (session, step), of which only these two columns are read.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import config, log, start, twice
from spindrift.functions import scalars
from spindrift.operators import storage
from spindrift.streaming import telemetry

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "goal_log.json")
_TURNS = "session long, step long, goal string, goal_id string, chars long, words long, batch long, author string"
_REJECTED = "session long, step long, rows long, batch long, reason string"


def checked(turns: DataFrame, settings: dict) -> DataFrame:
    """(session, step, author, goal, reason): turns with their goal normalized and, if they are no good, why."""
    made = turns.select(F.col(settings["session"]).cast("long").alias("session"), F.col(settings["step"]).cast("long").alias("step"), F.col(settings["author"]).alias("author"), scalars.normalized_goal(F.col(settings["text"])).alias("goal"))
    reason = F.when(F.col("session").isNull(), "no session").when(F.col("step").isNull(), "no step").when(~F.coalesce(F.col("author").isin(settings["authors"]), F.lit(False)), "author").when(F.col("goal").isNull(), "no text")
    return made.withColumn("reason", reason)


def first_turns(turns: DataFrame) -> DataFrame:
    """Of each (session, step) the author and goal that sort first."""
    order = Window.partitionBy("session", "step").orderBy("author", "goal")
    return turns.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def _put(rows: DataFrame, path: str, batch: int, *by: str) -> None:
    """A batch's rows in its own partitions: in place of those that an earlier try left, or of all where a checkpoint begins."""
    if batch == 0:
        rows.write.mode("overwrite").partitionBy("batch", *by).parquet(path)
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)


def take(rows: DataFrame, batch: int, out: str, settings: dict) -> None:
    """One micro-batch, from raw turns to its partitions of the log."""
    spark = rows.sparkSession
    found = checked(rows, settings).persist()  # goes to two tables
    bad = found.where("reason is not null").groupBy("session", "step", "reason").agg(F.count("*").alias("rows"))
    _put(bad.select("session", "step", "rows", F.lit(batch).cast("long").alias("batch"), "reason"), f"{out}/rejected", batch, "reason")
    new = first_turns(found.where("reason is null").drop("reason"))
    if batch:
        before = spark.read.schema(_TURNS).parquet(f"{out}/turns").where(F.col("batch") < batch).select("session", "step")
        new = new.join(before, ["session", "step"], "left_anti")
    goal = F.col("goal")
    made = new.select("session", "step", "goal", F.sha2(goal.cast("binary"), 256).alias("goal_id"), F.length(goal).cast("long").alias("chars"), F.size(F.split(goal, " ", -1)).cast("long").alias("words"), F.lit(batch).cast("long").alias("batch"), "author")
    _put(made, f"{out}/turns", batch, "author")
    found.unpersist()


def run(spark: SparkSession, source: str, out: str, settings: dict) -> DataFrame:
    """Take what is new below source into the log at out; the turns of the whole log as they stand then."""
    stream = telemetry.from_files(spark, f"{source}/{settings['path']}", settings["schema"], settings["files_per_batch"])
    query = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(lambda rows, batch: take(rows, batch, out, settings)).start()
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    for p in batches:
        log.info("read batch %d: %d rows", p["batchId"], p["numInputRows"])
    log.info("read %d batches, %d rows that were new", len(batches), sum(p["numInputRows"] for p in batches))
    if not storage.exists(spark, f"{out}/turns"):  # no file has come yet
        take(spark.createDataFrame([], settings["schema"]), 0, out, settings)
    for name, schema in (("turns", _TURNS), ("rejected", _REJECTED)):
        table = spark.read.schema(schema).parquet(f"{out}/{name}")
        for r in table.groupBy("batch").count().orderBy(F.desc("batch")).limit(20).collect():
            log.info("stands in %s, batch %d: %d rows", name, r.batch, r["count"])
    return spark.read.schema(_TURNS).parquet(f"{out}/turns")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.goal_log", description=__doc__.split("\n")[0])
    parser.add_argument("--input", required=True, help="folder that holds the sessions' table")
    parser.add_argument("--output", required=True, help="folder of the log and its checkpoint")
    parser.add_argument("--config", default=f"file://{CONFIG}")
    chosen = parser.parse_args(args)
    spark = start("goal-log")
    try:
        run(spark, chosen.input, chosen.output, config(spark, chosen.config, ("path", "schema", "session", "step", "author", "text", "authors", "files_per_batch")))
    finally:
        spark.stop()


def _registered(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    import json

    with open(CONFIG) as file:  # beside this module, on the driver
        settings = json.load(file)
    return run(spark, sf_dir, out, settings)


job2_goal_log = twice("job2", _registered)

if __name__ == "__main__":
    main()
