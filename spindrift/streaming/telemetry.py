"""Telemetry as streams: event-time chunks, latest values, sampling, stateful sessions. Every function takes a batch or a stream unless it says so."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import folds, storage


def as_stream(spark, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; timestamps without zone become UTC instants, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def from_files(spark, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files as a stream, path being their folder or a single file (of which the folder is watched, for this name)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return rows.parquet(path)
    return rows.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def chunks(events: DataFrame, time: str, width: str, by: list[str], value: str, lateness: str = "1 hour") -> DataFrame:
    """(start, by, n, total): tumbling windows; on a stream, events later than lateness are left out."""
    late = events.withWatermark(time, lateness) if events.isStreaming else events
    return late.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, time: str, width: str, slide: str, by: list[str], value: str, lateness: str = "1 hour") -> DataFrame:
    late = events.withWatermark(time, lateness) if events.isStreaming else events
    return late.groupBy(F.window(time, width, slide).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], lateness: str = "1 hour") -> DataFrame:
    """(start, end, by, n): runs of events with less than gap between them."""
    late = events.withWatermark(time, lateness) if events.isStreaming else events
    return late.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def latest(events: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """(by, values, dropped): each key's newest row and how many older ones gave way; ties go to the later columns of order."""
    newest = F.max(F.struct(*order, *[F.col(v).alias(f"v_{v}") for v in values])).alias("newest")
    return events.groupBy(*by).agg(newest, (F.count("*") - 1).alias("dropped")).select(*by, *[F.col(f"newest.v_{v}").alias(v) for v in values], "dropped")


def sampled(events: DataFrame, by: list[str], time_s: str, order: str, hz: float) -> DataFrame:
    """Batch: the first event of each 1/hz slot."""
    slot = F.floor(F.col(time_s) * hz)
    return events.withColumn("slot", slot).withColumn("__n", F.row_number().over(Window.partitionBy(*by, "slot").orderBy(time_s, order))).where("__n = 1").drop("__n")


def first_events(events: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Batch: the first most events of each key, with the key's dropped count."""
    w = Window.partitionBy(*by)
    return events.withColumns({"__n": F.row_number().over(w.orderBy(*order)), "dropped": F.greatest(F.lit(0), F.count("*").over(w) - most)}).where(F.col("__n") <= most).drop("__n")


def ring(events: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Batch: each key's newest size rows, age 0 the newest."""
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("age", F.row_number().over(newest) - 1).where(F.col("age") < size)


def distinct_chunks(events: DataFrame, keys: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """One row for each key; on a stream within the lateness."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def pulses_in_chunks(pulses: DataFrame, chunks: DataFrame, by: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Pulses (by, pulse_at, ...) with the chunk (by, chunk_at, ...) they fall in: chunk_at <= pulse_at < chunk_at + width.

    On streams either side may come first, out of order by up to lateness; a row waits in the state until no partner can come
    any more, so the state holds a width and a lateness of each side. Rows later than that are left out; Late puts those of a batch aside.
    """
    if pulses.isStreaming:
        pulses, chunks = pulses.withWatermark("pulse_at", lateness), chunks.withWatermark("chunk_at", lateness)
    other = chunks.withColumnRenamed(by, "__by")
    within = (F.col("pulse_at") >= F.col("chunk_at")) & (F.col("pulse_at") < F.col("chunk_at") + F.expr(f"INTERVAL {width}"))
    return pulses.join(other, (F.col(by) == F.col("__by")) & within).drop("__by")


class Late:
    """A side output of late rows. Each micro-batch is split by the newest time before it less the lateness, kept in a small table with the batch's number."""

    def __init__(self, path: str, time: str, lateness_s: float):
        self.path, self.time, self.lateness_s = path.rstrip("/"), time, lateness_s

    def split(self, batch: DataFrame, number: int) -> DataFrame:
        """The rows in time; the late ones go to path/late, in the batch's own partition. A batch that comes again is split as it was."""
        spark = batch.sparkSession
        newest = F.max(F.unix_micros(self.time)).alias("newest")
        marks = spark.read.schema("newest long, batch long").parquet(f"{self.path}/marks") if number and storage.exists(spark, f"{self.path}/marks") else None
        before = marks.where(F.col("batch") < number).agg(F.max("newest")).first()[0] if marks is not None else None
        put = lambda df, name: df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")
        is_late = F.lit(False) if before is None else F.coalesce(F.unix_micros(self.time) < F.lit(before - round(self.lateness_s * 1e6)), F.lit(False))
        put(batch.where(is_late), "late")
        put(batch.agg(newest), "marks")
        return batch.where(~is_late)


def stale(now_ms, last_ms, limit: int = 2000):
    return (last_ms > 0) & (now_ms - last_ms > limit)


def projected(payloads: DataFrame) -> DataFrame:
    """A versioned envelope of raw frames (kind, experiment_id, chunks, simulated_time_s, status, reason, chunk_spikes, total_spikes): what wasn't measured is null."""
    measured = F.coalesce(F.col("kind") == "telemetry", F.lit(False))
    when = lambda c: F.when(measured, F.col(c)).alias(c)
    return payloads.select(
        F.lit(2).alias("schema_version"), F.when(measured, "simulated_neural_measurement").otherwise("session_status").alias("source"), F.col("experiment_id").alias("session_id"),
        F.when(measured, F.col("chunks")).alias("step_id"), "simulated_time_s", F.coalesce("status", F.lit("unknown")).alias("status"), "reason", when("chunk_spikes"), when("total_spikes"),
    )


#: Which action is legal in which session state, and the state after it. Fixed values.
TRANSITIONS = {
    ("idle", "start"): "running", ("completed", "start"): "running", ("stopped", "start"): "running", ("failed", "start"): "running",
    ("running", "pause"): "paused", ("paused", "resume"): "running", ("running", "observe"): "running", ("paused", "observe"): "paused",
    ("running", "finish"): "completed", ("running", "reset"): "idle", ("paused", "reset"): "idle", ("idle", "reset"): "idle", ("completed", "reset"): "idle", ("stopped", "reset"): "idle", ("failed", "reset"): "idle",
    ("running", "shutdown"): "stopped", ("paused", "shutdown"): "stopped", ("idle", "shutdown"): "stopped", ("completed", "shutdown"): "stopped", ("failed", "shutdown"): "stopped",
}


def next_state(state: str, action: str) -> tuple[str, bool]:
    """The state after an action, and whether it was legal; illegal ones change nothing."""
    after = TRANSITIONS.get((state, action))
    return (after, True) if after else (state, False)


def session_states(commands: DataFrame, by: list[str], order: list[str], action: str = "action") -> DataFrame:
    """Batch: (by, position, action, state, legal): commands in order from idle. A null action is illegal."""
    states = sorted({s for s, _ in TRANSITIONS} | set(TRANSITIONS.values()))
    shown = lambda before, after, a: {"action": a, "state": after, "legal": (before, a) in TRANSITIONS}
    fold = folds.machine(states, "idle", lambda state, a: next_state(state, a)[0], ("action",), shown)
    return folds.folded(commands, by, order, {"action": F.col(action)}, fold, "action string, state string, legal boolean")


def session_stream(commands: DataFrame, key: str = "session", order: str = "seq") -> DataFrame:
    """Stream: (session, seq, action, state, legal) with the state kept between micro-batches; within one, commands go by seq."""

    def fold(key_: tuple, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        (state,) = kept.get if kept.exists else ("idle",)
        rows = []
        for row in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            state, legal = next_state(state, row.action)
            rows.append((key_[0], getattr(row, order), row.action, state, legal))
        kept.update((state,))
        yield pd.DataFrame(rows, columns=["session", "seq", "action", "state", "legal"])

    return commands.groupBy(key).applyInPandasWithState(fold, "session string, seq long, action string, state string, legal boolean", "state string", "append", "NoTimeout")


def replay_steps(episodes: DataFrame) -> DataFrame:
    """(episode, step, dx, dy, distance_delta, improved) of nested episodes(episode, steps: array of x0, y0, x1, y1, distance_before, distance_after)."""
    flat = episodes.select("episode", F.posexplode("steps").alias("step", "s"))
    return flat.select("episode", "step", (F.col("s.x1") - F.col("s.x0")).alias("dx"), (F.col("s.y1") - F.col("s.y0")).alias("dy"), (F.col("s.distance_before") - F.col("s.distance_after")).alias("distance_delta"), (F.col("s.distance_after") < F.col("s.distance_before")).alias("improved"))


#: Recordings by how many axes they have: the axes' names, what their probes are called, and the labels of their scores. Fixed values.
AXES = {"horizontal": ("LEFT", "RIGHT"), "vertical": ("UP", "DOWN")}
KINDS = {"horizontal-1d": ("horizontal",), "vertical-1d": ("vertical",), "factorized-2d": ("horizontal", "vertical")}


def recorded_steps(steps: DataFrame, most_episodes: int = 64, most_steps: int = 4096) -> DataFrame:
    """Steps of recordings in one form: (recording, episode, step, event_id, axes, labels, before_x, before_y, target_x, target_y, dx, dy, distance_delta, improved).

    steps: recording (one of KINDS), episode, step, before, after and target (structs x, y, where an axis that the recording
    lacks is null and counts as the middle), distance_before, distance_after. Episodes and steps beyond the
    bounds, and unknown recordings, raise while they're read.
    """
    middle = lambda c: F.coalesce(F.col(c), F.lit(0.5))
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in KINDS.items() for x in (k, v)])
    labels = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in AXES.items() for x in (k, v)])
    axes = F.try_element_at(known, F.col("recording"))
    bad = axes.isNull() | (F.col("episode") >= most_episodes) | (F.col("step") >= most_steps)
    checked = F.when(~F.coalesce(bad, F.lit(True)), F.col("recording")).otherwise(F.raise_error(F.lit("unknown recording, or beyond its bounds")).cast("string"))
    return steps.select(
        checked.alias("recording"), "episode", "step", F.concat(F.col("recording"), F.lit(":episode-"), F.col("episode") + 1, F.lit(":step-"), F.col("step")).alias("event_id"),
        F.array_join(axes, ",").alias("axes"), F.array_join(F.flatten(F.transform(axes, lambda a: F.try_element_at(labels, a))), ",").alias("labels"),
        middle("before.x").alias("before_x"), middle("before.y").alias("before_y"), middle("target.x").alias("target_x"), middle("target.y").alias("target_y"),
        (middle("after.x") - middle("before.x")).alias("dx"), (middle("after.y") - middle("before.y")).alias("dy"),
        (F.col("distance_before") - F.col("distance_after")).alias("distance_delta"), (F.col("distance_after") < F.col("distance_before")).alias("improved"),
    )


def recording_catalog(spark, folder: str, files: dict[str, str]) -> DataFrame:
    """(recording, file, available) of the named recordings, and of nothing else in the folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(name, file, bool(system.exists(jvm.org.apache.hadoop.fs.Path(where, file)))) for name, file in sorted(files.items())]
    return spark.createDataFrame(rows, "recording string, file string, available boolean")
