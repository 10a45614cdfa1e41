"""Feature rows of runs: time windows, slices of drives, vectors by modality, matrices by key, member metrics with fixed names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_drive(drive: DataFrame, start: int, stop: int) -> DataFrame:
    """(label, step, amplitude) of steps start to stop - 1, counted from start."""
    return drive.where((F.col("step") >= start) & (F.col("step") < stop)).withColumn("step", F.col("step") - start)


def feature_window(samples: DataFrame, time_s: str, baseline_frames: int, rate_hz: float) -> DataFrame:
    """Samples from the end of the baseline on."""
    return samples.where(F.col(time_s) >= baseline_frames / rate_hz)


def window_features(traces: DataFrame, by: list[str], v: str, g: str, rest: float) -> DataFrame:
    """(by, voltage, drive): signed peaks of voltage over rest and of drive; of equal sizes the positive one."""
    delta = F.col(v) - rest
    peak = lambda x: F.when(F.abs(F.max(x)) >= F.abs(F.min(x)), F.max(x)).otherwise(F.min(x))
    return traces.groupBy(*by).agg(peak(delta).alias("voltage"), peak(F.col(g)).alias("drive"))


#: The columns that each modality's vector is made of; temporal ones are matrices, row after row. Fixed values.
MODALITIES = {
    "voltage": ("voltage",), "drive": ("drive",), "spike": ("spike",), "concat": ("voltage", "drive", "spike"),
    "temporal_voltage": ("temporal_voltage",), "temporal_drive": ("temporal_drive",), "temporal_concat": ("temporal_voltage", "temporal_drive"),
}


def feature_vector(modality: str) -> Column:
    """The vector of a modality from array columns (temporal ones: arrays of arrays)."""
    if modality not in MODALITIES:
        raise ValueError(f"no modality {modality!r}")
    parts = [F.flatten(c) if c.startswith("temporal") else F.col(c) for c in MODALITIES[modality]]
    return F.concat(*parts)


def keyed_rows(samples: DataFrame, keys: list[float], key: str, vector: Column) -> DataFrame:
    """(at, key, features): samples' vectors in the order of keys; a missing key raises while it's read, and a repeated one gives rows each."""
    wanted = samples.sparkSession.createDataFrame([(i, float(k)) for i, k in enumerate(keys)], "at int, key double")
    found = wanted.join(samples.select(F.col(key).cast("double").alias("key"), vector.alias("features")), "key", "left")
    raised = F.raise_error(F.concat(F.lit("no sample at "), F.col("key").cast("string"))).cast("array<double>")
    return found.select("at", "key", F.when(F.col("features").isNotNull(), F.col("features")).otherwise(raised).alias("features"))


def latest_rows(artifacts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all artifacts; of one key those of the last artifact that has it, and there the last by all columns."""
    columns = artifacts[0].columns
    numbered = reduce(DataFrame.unionByName, [a.select(*columns, F.lit(i).alias("__artifact")) for i, a in enumerate(artifacts)])
    newest = Window.partitionBy(key).orderBy(F.desc("__artifact"), *[F.desc(c) for c in columns if c != key])
    return numbered.withColumn("__at", F.row_number().over(newest)).where("__at = 1").select(*columns)


def member_features(members: DataFrame, by: list[str], populations: list[str], metrics: list[str]) -> DataFrame:
    """(by, name, value): each member's metrics, named population:instance:body:metric, at a fixed place (at) in its run.

    members: by, population, instance, body_id and the metrics. Order: populations as given, members by body id, metrics as given.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in populations]), F.col("population"))
    pairs = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)])
    long = members.withColumn("p", rank).where("p > 0").select(*by, "p", "body_id", F.concat_ws(":", "population", "instance", "body_id").alias("label"), F.explode(pairs).alias("x"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy("p", "body_id", "x.m")) - 1
    return long.select(*by, at.alias("at"), F.concat_ws(":", "label", "x.metric").alias("name"), F.col("x.value").alias("value"))


def name_changes(features: DataFrame, run: str) -> DataFrame:
    """(at, names): places whose name isn't the same in all runs; none in sound artifacts."""
    return features.groupBy("at").agg(F.count_distinct("name").alias("names"), F.count_distinct(run).alias("runs")).where("names > 1").select("at", "names")


def population_vector(runs: DataFrame, by: list[str], populations: list[str], value: str) -> DataFrame:
    """(by, features): one value per population, in the order given; an absent one is null."""
    picked = [F.max(F.when(F.col("population") == p, F.col(value))) for p in populations]
    return runs.groupBy(*by).agg(F.array(*picked).alias("features"))


def projected_drive(channels: DataFrame, weights: DataFrame) -> DataFrame:
    """(step, target_index, drive): weights (label, target_index, weight) times the channels' amplitudes (label, step, amplitude), summed."""
    live = channels.where("amplitude <> 0")
    return live.join(weights, "label").groupBy("step", "target_index").agg(F.sum(F.col("amplitude") * F.col("weight")).alias("drive"))
