"""Populations: named neuron sets with deterministic samples, and set algebra on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(neurons: DataFrame, specs: DataFrame, columns: list[str]) -> DataFrame:
    """(key, rank, neuron_index, body_id, available): for each spec the first sample_limit matches by body id.

    specs: key, sample_limit (null: all) and columns; a spec's null column matches anything. All specs are
    resolved in one join; a population that stays empty has no row (see empty()).
    """
    wanted = F.broadcast(specs.select("key", "sample_limit", *[F.col(c).alias(f"want_{c}") for c in columns]))
    match = F.lit(True)
    for c in columns:
        match = match & (F.col(f"want_{c}").isNull() | (F.col(c) == F.col(f"want_{c}")))
    order = Window.partitionBy("key").orderBy("body_id")
    found = neurons.join(wanted, match).withColumn("rank", F.row_number().over(order)).withColumn("available", F.count("*").over(Window.partitionBy("key")))
    return found.where(F.col("sample_limit").isNull() | (F.col("rank") <= F.col("sample_limit"))).select("key", "rank", "neuron_index", "body_id", "available")


def empty(specs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Keys of specs that no neuron matches: an error to the caller."""
    return specs.select("key").join(resolved.select("key").distinct(), "key", "left_anti")


def first(population: DataFrame, n: int, by: str = "rank") -> DataFrame:
    return population.where(F.col(by) <= n)


def by_sign(neurons: DataFrame) -> DataFrame:
    """(sign, n, first_member, last_member): how many neurons have each sign, and the first and last of their indices."""
    return neurons.groupBy("sign").agg(F.count("*").alias("n"), F.min("neuron_index").alias("first_member"), F.max("neuron_index").alias("last_member"))


def sign_members(neurons: DataFrame) -> DataFrame:
    """(sign, neuron_index): the same sets as rows."""
    return neurons.select("sign", "neuron_index")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order fixed by key and seed; a smaller n gives a prefix."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def ordered_union(key: str, *sets: DataFrame) -> DataFrame:
    """(key, position): members in order of first occurrence over the sets, each ordered by its position column."""
    out = None
    for i, s in enumerate(sets):
        s = s.select(key, F.struct(F.lit(i).alias("set"), F.col("position").alias("at")).alias("first"))
        out = s if out is None else out.unionByName(s)
    seen = out.groupBy(key).agg(F.min("first").alias("first"))
    return seen.withColumn("position", F.row_number().over(Window.orderBy("first", key)) - 1).drop("first")  # watch lists, bounded by the caller


def cross_conditions(inputs: DataFrame, amplitudes: list[float], durations_ms: list[float], repeats: int) -> DataFrame:
    """(condition_id, input_key, amplitude, duration_ms, repeat): the product of the parameters and one control per repeat."""
    spark = inputs.sparkSession
    a = spark.createDataFrame([(float(x),) for x in amplitudes], "amplitude double")
    d = spark.createDataFrame([(float(x),) for x in durations_ms], "duration_ms double")
    r = spark.range(repeats).select(F.col("id").cast("int").alias("repeat"))
    runs = inputs.select(F.col("key").alias("input_key")).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(d)).crossJoin(F.broadcast(r))
    short = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")  # noqa: E731  as %g shows small numbers
    named = runs.withColumn("condition_id", F.concat(F.col("input_key"), F.lit("-a"), short("amplitude"), F.lit("-d"), short("duration_ms"), F.lit("ms-r"), F.col("repeat")))
    controls = r.select(F.concat(F.lit("control-r"), F.col("repeat")).alias("condition_id"), F.lit(None).cast("string").alias("input_key"), F.lit(0.0).alias("amplitude"), F.lit(0.0).alias("duration_ms"), "repeat")
    return named.select("condition_id", "input_key", "amplitude", "duration_ms", "repeat").unionByName(controls)
