"""Frames, pulses, drives and recursive filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.scalars import filter_gain, half_up
from spindrift.operators import folds, storage


@dataclass(frozen=True)
class EarlyVision:
    """Time constants and gains of the graded filters. Fixed default values."""

    frame_rate_hz: float = 60.0
    dt_ms: float = 0.1
    background: float = 0.5
    tonic: float = 0.1
    photoreceptor_ms: float = 15.0
    fast_ms: float = 8.0
    slow_ms: float = 40.0
    l3_ms: float = 30.0
    l1_gain: float = 6.0
    l2_gain: float = 6.0
    l2_slow_weight: float = 1.05
    l3_gain: float = 6.0


def low_pass(x: np.ndarray, gain: float, start: float) -> np.ndarray:
    """y[i] = y[i-1] + gain (x[i] - y[i-1]) along the first axis."""
    out, y = np.empty_like(x), np.full(x.shape[1:], start)
    for i in range(len(x)):
        y = y + gain * (x[i] - y)
        out[i] = y
    return out


def graded_traces(luminance: np.ndarray, config: EarlyVision = EarlyVision()) -> dict[str, np.ndarray]:
    """Filter states per step of luminance per frame (frames x channels): photoreceptor, release, l1, l2, l3."""
    exact = len(luminance) / config.frame_rate_hz / (config.dt_ms / 1000)
    steps = round(exact)
    if abs(exact - steps) > 1e-9:
        raise ValueError("the frames' duration must be a whole number of steps")
    frame = np.minimum((np.arange(steps) * (config.dt_ms / 1000) * config.frame_rate_hz + 1e-12).astype(np.int64), len(luminance) - 1)
    rest = config.tonic + (1 - config.tonic) * config.background
    photo = low_pass(np.asarray(luminance, np.float64)[frame], filter_gain(config.dt_ms, config.photoreceptor_ms), config.background)
    release = config.tonic + (1 - config.tonic) * photo
    fast, slow, sustained = (low_pass(release, filter_gain(config.dt_ms, tau), rest) for tau in (config.fast_ms, config.slow_ms, config.l3_ms))
    w = config.l2_slow_weight
    return {"photoreceptor": photo, "release": release, "l1": -config.l1_gain * (fast - slow), "l2": -config.l2_gain * (fast - w * slow - (1 - w) * rest), "l3": -config.l3_gain * (sustained - rest)}


def graded_channels(frames: DataFrame, config: EarlyVision = EarlyVision()) -> DataFrame:
    """(channel, step, photoreceptor, release, l1, l2, l3) of frames (channel, frame, luminance): one group per channel."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        out = graded_traces(table.column("luminance").to_numpy()[:, None], config)
        n = len(out["l1"])
        return pa.table({"channel": pa.array([key[0].as_py()] * n, pa.int64()), "step": np.arange(n), **{k: v[:, 0] for k, v in out.items()}})

    return frames.select(F.col("channel").cast("long").alias("channel"), F.col("frame").cast("long").alias("frame"), F.col("luminance").cast("double").alias("luminance")).groupBy("channel").applyInArrow(work, "channel long, step long, photoreceptor double, release double, l1 double, l2 double, l3 double")


def low_pass_fold(df: DataFrame, by: list[str], value: str, order: str, gain: float, start: float) -> DataFrame:
    """(by, position, filtered): a first-order low-pass along each group, of any length."""
    return folds.folded(df, by, [order], {"x": F.col(value).cast("double")}, folds.low_pass(gain, float(start)), "filtered double")


def pulses(frames: DataFrame, rate_hz: float, most: int, dt_ms: float, by: list[str] | None = None) -> DataFrame:
    """(by, frame, pulse, time_s, step): floor(luminance x most + 0.5) pulses, evenly inside their frame, on the step grid (half up)."""
    period = 1.0 / rate_hz
    counted = frames.withColumn("count", half_up(F.col("luminance") * most).cast("int")).where("count > 0")
    spread = counted.withColumn("pulse", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    timed = spread.withColumn("time_s", F.col("frame") * period + (F.col("pulse") + 0.5) * period / F.col("count"))
    return timed.select(*(by or []), "frame", "pulse", "time_s", half_up(F.col("time_s") * 1000 / dt_ms).cast("long").alias("step"))


def pulse_train(members: DataFrame, start_s: float, stop_s: float, interval_s: float) -> DataFrame:
    """(neuron_index, time_s): a pulse of every member at start, start + interval, ... before stop."""
    n = max(0, math.ceil((stop_s - start_s) / interval_s - 1e-9))
    times = members.sparkSession.range(n).select((F.lit(start_s) + F.col("id") * interval_s).alias("time_s"))
    return members.select("neuron_index").crossJoin(F.broadcast(times))  # n times, fixed by the arguments


def drive_channels(traces: DataFrame, gain: float, epsilon: float, factor: float, delay_steps: int, keep_silent: bool = False) -> DataFrame:
    """(label, step, amplitude): clip(signal / gain) to -1..1, small ones 0, scaled, delayed. Channels that stay 0 go, as they drive nothing, unless keep_silent."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("signal") / gain))
    scaled = traces.withColumn("amplitude", F.when(F.abs(x) <= epsilon, 0.0).otherwise(x) * factor)
    w = Window.partitionBy("label")
    moved = scaled.withColumn("amplitude", F.lag("amplitude", delay_steps, 0.0).over(w.orderBy("step"))).select("label", "step", "amplitude")
    if keep_silent:
        return moved
    return moved.withColumn("__any", F.max(F.abs("amplitude")).over(w)).where("__any > 0").select("label", "step", "amplitude")


def demo_frames(spark: SparkSession, frames: int = 12, height: int = 144, width: int = 256, side: int = 24) -> DataFrame:
    """(frame, y, x, intensity): grey with a dark square that moves to the right."""
    grid = spark.range(frames * height * width).select((F.col("id") / (height * width)).cast("int").alias("frame"), ((F.col("id") / width) % height).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    left = F.col("frame") * ((width - side) // max(1, frames - 1))
    inside = F.col("x").between(left, left + side - 1) & F.col("y").between((height - side) // 2, (height + side) // 2 - 1)
    return grid.withColumn("intensity", F.when(inside, 0.1).otherwise(0.5))


def crop(pixels: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """The rectangle, with its own origin."""
    return pixels.where(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def color_blob(pixels: DataFrame, rgb: tuple[int, int, int], tolerance: int, least: int, width: int, height: int) -> DataFrame:
    """One row per frame that holds least pixels near the color: count, centroid in 0..1, bounding box."""
    near = F.greatest(*[F.abs(F.col(c) - v) for c, v in zip(("r", "g", "b"), rgb, strict=True)]) <= tolerance
    found = pixels.where(near).groupBy("frame").agg(F.count("*").alias("pixels"), (F.avg("x") / (width - 1)).alias("u"), (F.avg("y") / (height - 1)).alias("v"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    return found.where(F.col("pixels") >= least)


def bilinear(frames: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, key, value): frames (frame, y, x, intensity) sampled at points (key, u, v) in 0..1 from four neighbours.

    Each point becomes its neighbours' pixels with weights, which meet the frames by equality.
    """
    fx, fy = F.col("u") * (width - 1), F.col("v") * (height - 1)
    x0, y0 = F.floor(fx), F.floor(fy)
    corner = lambda dx, dy: F.struct(F.least(x0 + dx, F.lit(width - 1)).cast("int").alias("x"), F.least(y0 + dy, F.lit(height - 1)).cast("int").alias("y"), ((fx - x0 if dx else 1 - fx + x0) * (fy - y0 if dy else 1 - fy + y0)).alias("w"))
    corners = points.select("key", F.explode(F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)])).alias("c")).select("key", "c.x", "c.y", "c.w").groupBy("key", "x", "y").agg(F.sum("w").alias("w"))
    return frames.join(corners, ["x", "y"]).groupBy("frame", "key").agg(F.sum(F.col("intensity") * F.col("w")).alias("value"))


def chunk_pulses(chunks: DataFrame, neurons: DataFrame, start_s: float, stop_s: float, interval_s: float, dt_ms: float) -> DataFrame:
    """(chunk, neuron_index, number, time_s): a stimulus' pulses in each chunk (chunk, from_s, to_s), counted from the chunk's start on the step grid.

    Pulses fall at start, start + interval, ... before stop; a chunk has those from its start up to, not at, its end.
    """
    edge = 1e-12
    first = F.greatest(F.lit(0), F.ceil((F.greatest("from_s", F.lit(start_s)) - start_s) / interval_s - edge))
    last = F.ceil((F.least("to_s", F.lit(stop_s)) - edge - start_s) / interval_s) - 1
    numbered = chunks.withColumns({"a": first.cast("long"), "b": last.cast("long")}).where("a <= b").withColumn("number", F.explode(F.sequence("a", "b")))
    dt = dt_ms / 1000
    timed = numbered.withColumn("time_s", F.rint((F.lit(start_s) + F.col("number") * interval_s - F.col("from_s")) / dt) * dt + 0.0)
    return timed.select("chunk", "number", "time_s").crossJoin(storage.bounded(neurons.select("neuron_index"))).select("chunk", "neuron_index", "number", "time_s")
