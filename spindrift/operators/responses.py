"""Responses of layers, populations and targets; direction joins and consistency checks; control loops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(left: DataFrame, right: DataFrame, key: str, value: str, background: float) -> DataFrame:
    """left with right's value by key, background where there is none."""
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(background)))


def official_directions(raw: DataFrame, official: DataFrame) -> DataFrame:
    """raw (side, raw_p, raw_q, ...) joined with official (side, p, q, column) by grid position; right sides count p from 1."""
    placed = raw.withColumns({"p": F.when(F.col("side") == "R", F.col("raw_p") + 1).otherwise(F.col("raw_p")), "q": F.col("raw_q")})
    return placed.join(official, ["side", "p", "q"])


def unmatched(raw: DataFrame, official: DataFrame) -> DataFrame:
    """(side, n): raw positions without an official column."""
    placed = raw.withColumns({"p": F.when(F.col("side") == "R", F.col("raw_p") + 1).otherwise(F.col("raw_p")), "q": F.col("raw_q")})
    return placed.join(official, ["side", "p", "q"], "left_anti").groupBy("side").agg(F.count("*").alias("n"))


def anchor_error(measured: DataFrame, anchors: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """(missing, max_error): anchors that weren't measured, and the largest Euclidean distance to those that were."""
    both = anchors.join(measured.select(*keys, *[F.col(a).alias(f"m_{a}") for a in axes]), keys, "left")
    gap = F.sqrt(sum(((F.col(a) - F.col(f"m_{a}")) * (F.col(a) - F.col(f"m_{a}")) for a in axes), F.lit(0.0)))
    return both.agg(F.count_if(F.col(f"m_{axes[0]}").isNull()).alias("missing"), F.max(gap).alias("max_error"))


def mirror_angle(df: DataFrame, keys: list[str], side: str, forward: str, right: str, up: str) -> DataFrame:
    """(keys, angle_deg): angle between each right vector and its left partner mirrored; only complete pairs. Vectors are unit ones."""
    r = df.where(F.col(side) == "R").select(*keys, *[F.col(c).alias(f"r_{i}") for i, c in enumerate((forward, right, up))])
    left = df.where(F.col(side) == "L").select(*keys, *[F.col(c).alias(f"l_{i}") for i, c in enumerate((forward, right, up))])
    cosine = F.col("r_0") * F.col("l_0") - F.col("r_1") * F.col("l_1") + F.col("r_2") * F.col("l_2")
    return r.join(left, keys).select(*keys, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("angle_deg"))


def layer_response(traces: DataFrame, layers: DataFrame, threshold: float) -> DataFrame:
    """Per target and layer: members, largest and median peak |v|, members at threshold or more, members above 1e-12, spiking members.

    traces: neuron, v, spikes; layers: target, layer, neuron.
    """
    peak = traces.groupBy("neuron").agg(F.max(F.abs("v")).alias("peak"), F.sum("spikes").alias("spikes"))
    joined = layers.join(peak, "neuron", "left").fillna(0, ["peak", "spikes"])
    return joined.groupBy("target", "layer").agg(F.count("*").alias("members"), F.max("peak").alias("max_peak"), F.percentile("peak", 0.5).alias("median_peak"), F.count_if(F.col("peak") >= threshold).alias("responsive"), F.count_if(F.col("peak") > 1e-12).alias("moved"), F.count_if(F.col("spikes") > 0).alias("spiking"))


def hop_milestones(responses: DataFrame, by: list[str], hop: str, drive: str, spikes: str) -> DataFrame:
    """Per group: first hop without drive, last hop with drive (0 if none), first hop with spikes."""
    h = F.col(hop)
    return responses.groupBy(*by).agg(F.min(F.when(F.col(drive) == 0, h)).alias("first_silent_hop"), F.coalesce(F.max(F.when(F.col(drive) != 0, h)), F.lit(0)).alias("last_driven_hop"), F.min(F.when(F.col(spikes) > 0, h)).alias("first_spike_hop"))


def population_peaks(members: DataFrame, by: list[str], v: str, g: str, spikes: str) -> DataFrame:
    """Per group: mean, mean |.| and largest |.| of signed voltage and drive peaks, spikes, members."""
    parts = [f.alias(f"{name}_{c}") for c in (v, g) for name, f in (("mean", F.avg(c)), ("mean_abs", F.avg(F.abs(c))), ("max_abs", F.max(F.abs(c))))]
    return members.groupBy(*by).agg(F.count("*").alias("members"), *parts, F.sum(spikes).alias("spikes"))


def channel_difference(df: DataFrame, by: list[str], population: str, value: str, plus: str, minus: str) -> DataFrame:
    """(by, difference): value of one population less that of another; null where one is absent."""
    wide = df.groupBy(*by).agg(F.max(F.when(F.col(population) == plus, F.col(value))).alias("__a"), F.max(F.when(F.col(population) == minus, F.col(value))).alias("__b"))
    return wide.select(*by, (F.col("__a") - F.col("__b")).alias("difference"))


def direct_response(traces: DataFrame, neuron: str, time: str, v: str, g: str, rest: float, least: float, start: float) -> DataFrame:
    """One row: members, responsive members (hyperpolarised by least or more), median and largest hyperpolarisation, extremes, first and last time that any is active."""
    depth = rest - F.col(v)
    per = traces.groupBy(neuron).agg(F.greatest(F.lit(0.0), F.max(depth)).alias("depth"), F.min(v).alias("min_v"), F.min(g).alias("min_g"))
    times = traces.where(depth >= least).agg((F.min(time) - start).alias("latency"), (F.max(time) - F.min(time)).alias("persistence"))
    return per.agg(F.count("*").alias("members"), F.count_if(F.col("depth") >= least).alias("responsive"), F.percentile("depth", 0.5).alias("median_depth"), F.max("depth").alias("max_depth"), F.min("min_v").alias("min_v"), F.min("min_g").alias("min_g")).crossJoin(times)  # one row each


def sweep(frames: DataFrame, background: float, frame: str, coordinate: str, intensity: str) -> DataFrame:
    """(frame, active, centroid, rises): contrast-weighted centroid of each frame, columns above background, and whether the centroid moved up."""
    contrast = F.greatest(F.lit(0.0), F.col(intensity) - background)
    per = frames.groupBy(frame).agg(F.count_if(F.col(intensity) > background + 1e-9).alias("active"), F.try_divide(F.sum(F.col(coordinate) * contrast), F.sum(contrast)).alias("centroid"))
    return per.withColumn("rises", F.coalesce(F.col("centroid") > F.lag("centroid").over(Window.orderBy(frame)), F.lit(True)))  # a row per frame


def group_status(preserve: Column, wrong: Column) -> Column:
    return F.when(preserve & ~wrong, "preserving").when(wrong & ~preserve, "reversed").otherwise("mixed")


def cross_target(df: DataFrame, by: list[str], status: str, error: str, axis: str, target: str) -> DataFrame:
    """Per group: evaluations, how many of each status and their shares, mean error, distinct axes and targets."""
    n = F.count("*")
    parts = [x for s in ("preserving", "reversed", "mixed") for x in (F.count_if(F.col(status) == s).alias(s), F.try_divide(F.count_if(F.col(status) == s).cast("double"), n).alias(f"{s}_share"))]
    return df.groupBy(*by).agg(n.alias("evaluations"), *parts, F.avg(error).alias("mean_error"), F.count_distinct(axis).alias("axes"), F.count_distinct(target).alias("targets"))


def failure_histogram(df: DataFrame, hop: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(hop).cast("string"), F.lit("none")).alias("first_failed_hop")).agg(F.count("*").alias("n"))


def sensitivity(df: DataFrame, by: list[str], value: str, spikes: str) -> DataFrame:
    """Per setting: largest value, its range, whether any run spiked."""
    return df.groupBy(*by).agg(F.max(value).alias("largest"), (F.max(value) - F.min(value)).alias("range"), F.bool_or(F.col(spikes) > 0).alias("any_spike"))


def side_accuracy(df: DataFrame, by: list[str], actual: str, predicted: str, center: float) -> DataFrame:
    """Per group: rows off the centre, and the share predicted on their side of it."""
    off = df.where(F.col(actual) != center)
    return off.groupBy(*by).agg(F.count("*").alias("n"), F.avg(((F.col(predicted) > center) == (F.col(actual) > center)).cast("double")).alias("side_accuracy"))


def activity_frame(spikes: DataFrame, selected: DataFrame, neuron: str, duration: float, full_hz: float = 50.0) -> DataFrame:
    """(neuron, spikes, rate_hz, brightness) of selected neurons that were active: brightness reaches 1 at full_hz."""
    n = spikes.join(selected, neuron, "left_semi").groupBy(neuron).agg(F.count("*").alias("spikes"))
    rate = F.col("spikes") / F.lit(duration)
    return n.select(neuron, "spikes", rate.alias("rate_hz"), F.least(F.lit(1.0), rate / full_hz).alias("brightness"))


def replay_angles(df: DataFrame, by: list[str], dx: str, dy: str, score: str) -> DataFrame:
    """df with the direction of a move in degrees and |score| over the group's largest (0 if that is 0); no probability."""
    most = F.max(F.abs(score)).over(Window.partitionBy(*by))
    return df.withColumns({"angle_deg": F.degrees(F.atan2(dy, dx)), "strength": F.coalesce(F.try_divide(F.abs(score), most), F.lit(0.0))})


def heartbeats(events: DataFrame, by: list[str], time: str, gap: float) -> DataFrame:
    """(by, after, beats): silences longer than gap, and how many heartbeats gap apart fall in each."""
    after = F.lead(time).over(Window.partitionBy(*by).orderBy(time))
    silent = events.select(*by, F.col(time).alias("after"), (after - F.col(time)).alias("silence")).where(F.col("silence") > gap)
    return silent.select(*by, "after", (F.ceil(F.col("silence") / gap) - 1).cast("long").alias("beats"))


def budget_stop(df: DataFrame, limits: dict[str, float], order: tuple[str, ...] = ("wall_s", "memory_mb", "spikes", "edges")) -> DataFrame:
    """df with stop: the first limit in order that a row exceeds; non-finite voltages come first; null: none."""
    stop = F.when(~F.coalesce(F.abs("voltage") < F.lit(math.inf), F.lit(False)), "non_finite")
    for name in order:
        if name in limits:
            stop = stop.when(F.col(name) > limits[name], name)
    return df.withColumn("stop", stop)


def percent_difference(df: DataFrame, by: str, value: str, baseline: str) -> DataFrame:
    """(by, median, percent): each group's median against the baseline group's."""
    med = df.groupBy(by).agg(F.percentile(value, 0.5).alias("median"))
    base = med.where(F.col(by) == baseline).select(F.col("median").alias("__b"))
    return med.crossJoin(F.broadcast(base)).select(by, "median", (F.try_divide(F.col("median"), F.col("__b")) * 100 - 100).alias("percent"))  # one row


def unique_sources(df: DataFrame, column: str, kind: str, source: str) -> DataFrame:
    """(column, kind, source) where a column has one source of a kind; competing sources raise while they're read."""
    n = df.groupBy(column, kind).agg(F.min(source).alias(source), F.count_distinct(source).alias("__n"))
    return n.withColumn(source, F.when(F.col("__n") == 1, F.col(source)).otherwise(F.raise_error(F.lit("competing sources")).cast("long"))).drop("__n")


def _peaks(traces: DataFrame, neuron: str, v: str, g: str, rest: float) -> DataFrame:
    delta = F.col(v) - rest
    return traces.groupBy(neuron).agg(F.max(F.abs(delta)).alias("peak_v"), F.max(F.abs(g)).alias("peak_g"), F.max(delta).alias("max_v"), F.min(delta).alias("min_v"))


def subthreshold(traces: DataFrame, neuron: str, v: str, g: str, rest: float, threshold: float) -> DataFrame:
    """One row: watched and responsive neurons (|v - rest| of threshold or more), largest and median peak voltage, largest drive, extremes."""
    if threshold <= 0:
        raise ValueError("the threshold is positive")
    return _peaks(traces, neuron, v, g, rest).agg(F.count("*").alias("watched"), F.count_if(F.col("peak_v") >= threshold).alias("responsive"), F.max("peak_v").alias("max_peak"), F.percentile("peak_v", 0.5).alias("median_peak"), F.max("peak_g").alias("max_drive"), F.max("max_v").alias("max_delta"), F.min("min_v").alias("min_delta"))


def subthreshold_top(traces: DataFrame, neuron: str, v: str, g: str, rest: float, n: int = 10) -> DataFrame:
    """(neuron, peak_v, peak_g): the n neurons of the largest peaks; ties by neuron."""
    return _peaks(traces, neuron, v, g, rest).orderBy(F.desc("peak_v"), neuron).limit(n).select(neuron, "peak_v", "peak_g")
