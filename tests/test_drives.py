"""Drive channels whose signal never leaves the dead zone, as on large tables, where averages come near their mean."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from spindrift import catalog
from spindrift.operators import signals


def test_silent_channels_are_kept_by_the_query(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, 1 + day, 12)
    rows = [(10 * day + i, at(day), i, kind, value) for day in range(6) for i, (kind, value) in enumerate((("silent", 50.5), ("late", 50.0 + 9.0 * (day > 3)), ("loud", 40.0 + 4.0 * day)))]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.execute(catalog.oracle_sql()["drive_channels"]).fetchall())
    got = sorted((r.label, r.step, r.amplitude) for r in catalog.queries()["drive_channels"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == 18


def test_silent_channels_drive_nothing(spark):
    traces = spark.range(8).select(F.when(F.col("id") < 4, "a").otherwise("b").alias("label"), (F.col("id") % 4).alias("step"), F.when(F.col("id") < 4, 0.1).otherwise(F.col("id").cast("double")).alias("signal"))
    assert {r.label for r in signals.drive_channels(traces, 5.0, 0.2, 3.0, 1).collect()} == {"b"}
