"""Pixel sequences to inputs of columns and neurons: admission, generated screens, encoding, content hashes, photoreceptors.

Frames are rows (frame, y, x, intensity), intensities in 0..1; screens are counted from the top left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import scalars as sc
from spindrift.operators import signals, storage


def admit(frames: DataFrame, most_frames: int, most_pixels: int) -> DataFrame:
    """One row: frames, height, width, reason (null: admitted) of a sequence. A sequence without a pixel is not admitted.

    Reasons, the first that holds: empty, too many frames, too many pixels, missing pixels, values (null, not finite or outside 0..1).
    """
    x = F.col("intensity")
    bad = F.count_if(F.coalesce(F.isnan(x) | (x < 0) | (x > 1), F.lit(True)))
    one = frames.agg(F.count("*").alias("n"), F.count_distinct("frame").alias("frames"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), bad.alias("bad"))
    pixels = F.col("height") * F.col("width")
    reason = F.when(F.col("n") == 0, "empty").when(F.col("frames") > most_frames, "too many frames").when(pixels > most_pixels, "too many pixels").when(F.col("n") != F.col("frames") * pixels, "missing pixels").when(F.col("bad") > 0, "values")
    return one.select("frames", "height", "width", reason.alias("reason"))


def uniform_luminance(frames: DataFrame) -> DataFrame:
    """(frame, luminance): the mean of each image over all of its pixels (and channels, as rows)."""
    return frames.groupBy("frame").agg(F.avg("intensity").alias("luminance"))


@dataclass(frozen=True)
class Screen:
    """A screen of pixels with a bar on it. Intensities are in 0..1, bar_width is a part of the extent."""

    width: int = 160
    height: int = 120
    background: float = 0.5
    dark: float = 0.0
    bright: float = 1.0
    bar_width: float = 0.1

    def __post_init__(self):
        if min(self.width, self.height) < 2 or not 0 < self.bar_width < 1 or not all(0 <= x <= 1 for x in (self.background, self.dark, self.bright)):
            raise ValueError("a screen has 2 pixels or more each way, intensities in 0..1 and a bar narrower than itself")


def _bar(screen: Screen, axis: Column, position: Column) -> Column:
    """Whether pixel (y, x) lies on a bar around position of its axis; edges are rounded half to even."""
    across = axis == "horizontal"
    extent = F.when(across, screen.width).otherwise(screen.height)
    at = F.when(across, F.col("x")).otherwise(F.col("y"))
    edge = lambda d: F.rint((position + F.lit(d)) * (extent - 1))
    return at.between(edge(-screen.bar_width / 2), edge(screen.bar_width / 2))


def _pixels(spark: SparkSession, screen: Screen) -> DataFrame:
    if screen.height * screen.width > 1 << 22:  # a screen's pixels go to all tasks
        raise ValueError("a screen has at most 2^22 pixels")
    grid = spark.range(screen.height * screen.width)
    return grid.select((F.col("id") / screen.width).cast("int").alias("y"), (F.col("id") % screen.width).cast("int").alias("x"))


def bar_frames(spark: SparkSession, axis: str, positions: list[float], screen: Screen) -> DataFrame:
    """(frame, y, x, intensity): a dark bar at each of positions in turn."""
    when = spark.createDataFrame([(i, float(p)) for i, p in enumerate(positions)], "frame int, position double")
    shown = F.when(_bar(screen, F.lit(axis), F.col("position")), screen.dark).otherwise(screen.background)
    return _pixels(spark, screen).crossJoin(F.broadcast(when)).select("frame", "y", "x", shown.alias("intensity"))  # positions: the caller's list


def condition_frames(conditions: DataFrame, screen: Screen, before: int, during: int, after: int) -> DataFrame:
    """(condition, frame, y, x, intensity) of conditions (condition, kind, axis, position).

    kind: baseline (nothing), dark or bright: a bar at position of axis (horizontal or vertical) in the frames
    from before on, during of them. The pixels of a screen go to all tasks; conditions can be many.
    """
    spark = conditions.sparkSession
    frames = spark.range(before + during + after).select(F.col("id").cast("int").alias("frame"))
    every = conditions.crossJoin(F.broadcast(frames)).crossJoin(F.broadcast(_pixels(spark, screen)))
    bar = (F.col("kind") != "baseline") & F.col("frame").between(before, before + during - 1) & _bar(screen, F.col("axis"), F.col("position"))
    shown = F.when(bar & (F.col("kind") == "dark"), screen.dark).when(bar, screen.bright).otherwise(screen.background)
    return every.select("condition", "frame", "y", "x", shown.alias("intensity"))


def encode(frames: DataFrame, directions: DataFrame, width: int, height: int, field_deg: tuple[float, float], rate_hz: float, start_s: float = 0.0) -> DataFrame:
    """(key, frame, time_s, intensity): frames sampled at every visible direction (key, forward, right, up) on a screen ahead."""
    seen = directions.select("key", *sc.screen(F.col("forward"), F.col("right"), F.col("up"), *field_deg)).where("visible")
    sampled = signals.bilinear(frames, seen.select("key", "u", "v"), width, height)
    return sampled.select("key", "frame", (F.lit(start_s) + F.col("frame") / rate_hz).alias("time_s"), F.col("value").alias("intensity"))


def expand(encoding: DataFrame, neuron_columns: DataFrame, frames: DataFrame, background: float = 0.5) -> DataFrame:
    """(neuron_index, key, frame, intensity): each neuron (neuron_index, key) has its column's samples, or background off the screen.

    frames (frame): those of the sequence; a row each, sent to all tasks if they are few.
    """
    every = neuron_columns.crossJoin(storage.bounded(frames.select("frame").distinct()))
    return every.join(encoding.select("key", "frame", "intensity"), ["key", "frame"], "left").select("neuron_index", "key", "frame", F.coalesce("intensity", F.lit(background)).alias("intensity"))


def content_hash(frames: DataFrame, grain: float = 1e-9) -> DataFrame:
    """One row: frames and sha256 of a sequence. Equal images in an equal order have equal hashes, however their rows are dealt.

    A frame's text is its number and its pixels by y and x, in whole grains; the sequence's is its frames' hashes by number.
    Pixels of one frame meet in one task, and 64 bytes of each frame in the last.
    """
    pixel = F.concat_ws(":", "y", "x", F.rint(F.col("intensity") / grain).cast("long"))
    per = frames.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", pixel.alias("text")))).alias("pixels"))
    named = per.select("frame", F.sha2(F.concat_ws("|", F.col("frame").cast("string"), F.array_join(F.transform("pixels", lambda p: p["text"]), ",")), 256).alias("hash"))
    return named.agg(F.count("*").alias("frames"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", "hash"))), lambda p: p["hash"]), ","), 256).alias("sha256"))


def window_mean(samples: DataFrame, by: list[str], before: int, during: int) -> DataFrame:
    """(by, mean): mean intensity of the stimulus frames, from before on."""
    return samples.where(F.col("frame").between(before, before + during - 1)).groupBy(*by).agg(F.avg("intensity").alias("mean"))


def active(mean: Column, kind: Column, background: float, least: float = 1e-9) -> Column:
    """Whether a column's mean intensity departs from the background the way the kind of stimulus does."""
    return F.when(kind == "dark", mean < background - least).when(kind == "bright", mean > background + least).otherwise(False)


def photoreceptors(frames: DataFrame, config: signals.EarlyVision = signals.EarlyVision()) -> DataFrame:
    """(channel, step, luminance, state, release, release_delta) of frames (channel, frame, luminance): one group per channel.

    A channel starts adapted to the background; release_delta is 0 for a sequence of it.
    """
    rest = config.tonic + (1 - config.tonic) * config.background

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shown = table.sort_by("frame").column("luminance").to_numpy()
        if not np.isfinite(shown).all() or shown.min() < 0 or shown.max() > 1:
            raise ValueError("luminance must lie in 0 to 1")
        out = signals.graded_traces(shown[:, None], config)
        n = len(out["release"])
        frame = np.minimum((np.arange(n) * (config.dt_ms / 1000) * config.frame_rate_hz + 1e-12).astype(np.int64), len(shown) - 1)
        release = out["release"][:, 0]
        return pa.table({"channel": pa.array([key[0].as_py()] * n, pa.int64()), "step": np.arange(n), "luminance": shown[frame], "state": out["photoreceptor"][:, 0], "release": release, "release_delta": release - rest})

    return frames.select(F.col("channel").cast("long").alias("channel"), F.col("frame").cast("long").alias("frame"), F.col("luminance").cast("double").alias("luminance")).groupBy("channel").applyInArrow(work, "channel long, step long, luminance double, state double, release double, release_delta double")
