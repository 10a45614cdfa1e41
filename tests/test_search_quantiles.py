"""Reverse search with bit sets, exact quantiles by narrowing, joined streams: against plain ways."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph, metrics
from spindrift.streaming import telemetry


@pytest.mark.parametrize("targets", [1, 64, 65, 150])
def test_bits_equal_rows(spark, targets):
    rng = random.Random(targets)
    n = spark.createDataFrame([(i, rng.choice([-1, 0, 1, 1])) for i in range(160)], "neuron_index int, sign int")
    e = spark.createDataFrame(sorted({(rng.randrange(160), rng.choice([5, rng.randrange(160)])) for _ in range(420)}), "source_index int, target_index int")
    t = n.where(F.col("neuron_index") < targets)
    bits, slots = graph.reverse_bits(n, e, t, 3)
    rows = lambda df: sorted((r.target, r.node, r.distance) for r in df.collect())
    got = rows(graph.expanded(bits, slots))
    assert got == rows(graph.batched_reverse(n, e, t, 3)) and len(got) > targets
    # a frontier has at most a row for each node and 64 targets
    assert bits.groupBy("distance", "node").count().agg(F.max("count")).first()[0] <= -(-targets // 64)


def test_no_targets(spark):
    n = spark.createDataFrame([(0, 1)], "neuron_index int, sign int")
    e = spark.createDataFrame([(0, 0)], "source_index int, target_index int")
    assert graph.expanded(*graph.reverse_bits(n, e, n.limit(0), 2)).count() == 0


@pytest.mark.parametrize("small", [200_000, 20, 1])
def test_quantiles(spark, monkeypatch, small):
    monkeypatch.setattr(metrics, "SMALL", small)
    rng = np.random.default_rng(small)
    table = pd.concat([
        pd.DataFrame({"k": "normal", "x": rng.normal(size=3000)}),
        pd.DataFrame({"k": "ties", "x": np.where(rng.random(3000) < 0.97, 5.0, rng.integers(0, 9, 3000))}),
        pd.DataFrame({"k": "one", "x": [3.5]}), pd.DataFrame({"k": "two", "x": [1.0, 2.0]}), pd.DataFrame({"k": None, "x": np.arange(500) % 7}),
        pd.DataFrame({"k": "skewed", "x": np.exp(rng.normal(size=2000) * 6)}),
    ])
    df = spark.createDataFrame([(None if k is None else k, float(x)) for k, x in table.itertuples(index=False)] + [("normal", None), ("none", None)], "k string, x double")
    at = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.k, r.q): r.value for r in metrics.quantiles(df, ["k"], "x", at).collect()}
    want = {}
    for (k,), part in table.groupby(["k"], dropna=False):
        for q in at:
            want[(None if pd.isna(k) else k), q] = float(np.quantile(part.x, q))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)


def test_quantiles_of_one_group(spark, monkeypatch, sf):
    """A single group of all rows, narrowed in several rounds, as DuckDB has it."""
    monkeypatch.setattr(metrics, "SMALL", 50)
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = {r.q: r.value for r in metrics.quantiles(df, [], "l_extendedprice", [0.1, 0.5, 0.99]).collect()}
    want = duckdb.sql(f"select quantile_cont(l_extendedprice, [0.1, 0.5, 0.99]) from '{sf}/lineitem.parquet'").fetchall()[0][0]
    assert [got[q] for q in (0.1, 0.5, 0.99)] == pytest.approx(want) and len(got) == 3
    assert metrics.quantiles(df.limit(0), [], "l_extendedprice", [0.5]).count() == 0


def put(spark, folder, name, rows, column):
    time.sleep(0.05)
    spark.createDataFrame(rows, "k string, s double, id long").select("k", F.timestamp_seconds("s").alias(f"{column}_at"), F.col("id").alias(column)).coalesce(1).write.parquet(f"{folder}/{column}/{name}")


def test_joined_streams_out_of_order(spark, tmp_path):
    """Either side first, rows out of order within the lateness; what is too late stands aside, and the state doesn't grow."""
    folder, out = str(tmp_path), f"file://{tmp_path}/out"
    rng = random.Random(3)
    pulses, chunks, states = [], [], []
    late = telemetry.Late(f"{out}/side", "pulse_at", 5.0)

    def streams():
        read = lambda c: spark.readStream.schema(f"k string, {c}_at timestamp, {c} long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/{c}")
        return read("pulse"), read("chunk")

    for i in range(6):
        a = [(rng.choice("ab"), 1000 + 60.0 * i + rng.uniform(-15, 60), 100 * i + j) for j in range(20)]
        b = [(rng.choice("ab"), 1000 + 60.0 * i + rng.uniform(-15, 60), 100 * i + j) for j in range(20)]
        put(spark, folder, f"{i}", a, "pulse")
        put(spark, folder, f"{i}", b, "chunk")
        pulses += a
        chunks += b
        p, c = streams()
        q = telemetry.pulses_in_chunks(p, c, "k", "10 seconds", "90 seconds").writeStream.option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(lambda x, n: x.write.mode("overwrite").parquet(f"{out}/told/batch={n}")).start()
        q.awaitTermination()
        states.append(max((s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]), default=0))
        q = streams()[0].writeStream.option("checkpointLocation", f"{out}/log2").trigger(availableNow=True).foreachBatch(lambda x, n: late.split(x, n).write.mode("overwrite").parquet(f"{out}/intime/batch={n}")).start()
        q.awaitTermination()
    got = sorted((r.k, r.pulse, r.chunk) for r in spark.read.parquet(f"{out}/told").collect())
    want = sorted((k, p, c) for k, s, p in pulses for kk, t, c in chunks if k == kk and t <= s < t + 10)
    assert got == want and len(want) > 20
    assert max(states[3:]) <= 1.5 * max(states[:3])  # of 20 rows more on each side a run
    # late rows: older than the newest of earlier batches by more than 5 s
    newest, aside = None, []
    for i in range(6):
        part = pulses[20 * i : 20 * i + 20]
        aside += [p for _, s, p in part if newest is not None and s < newest - 5]
        newest = max([newest or 0, *(s for _, s, _ in part)])
    assert sorted(r.pulse for r in spark.read.parquet(f"{out}/side/late").collect()) == sorted(aside) and aside
    assert spark.read.parquet(f"{out}/intime").count() == len(pulses) - len(aside)


def test_joined_tables(spark):
    p = spark.createDataFrame([("a", 5.0, 1), ("a", 15.0, 2), (None, 5.0, 3)], "k string, s double, pulse long").select("k", F.timestamp_seconds("s").alias("pulse_at"), "pulse")
    c = spark.createDataFrame([("a", 5.0, 7), ("a", 0.0, 8), (None, 5.0, 9)], "k string, s double, chunk long").select("k", F.timestamp_seconds("s").alias("chunk_at"), "chunk")
    assert sorted((r.pulse, r.chunk) for r in telemetry.pulses_in_chunks(p, c, "k", "10 seconds").collect()) == [(1, 7), (1, 8)]
