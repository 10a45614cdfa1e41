"""Streams with state: restarts, out-of-order rows, timers, clients that stall or fail."""

import time

import pytest
from pyspark.sql import functions as F

from spindrift.streaming import clients, live

SCHEMA = "k string, at timestamp, n long, x double"


def feed(spark, folder, name, rows):
    """rows: (k, seconds, n, x) as one file, later files by name."""
    df = spark.createDataFrame(rows, "k string, s double, n long, x double").select("k", F.timestamp_seconds("s").alias("at"), "n", "x")
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, build, folder, out, mode="append", files=1):
    """What a stream over the files under folder tells, up to their end, with its checkpoint at out."""
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)
    with live.rocksdb(spark):
        q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/told/batch={i}")).start()
    q.awaitTermination()
    return [r.asDict() for r in spark.read.parquet(f"{out}/told").collect()]


PARTS = [
    [("a", 0.0, 1, 1.0), ("a", 0.2, 2, 2.0), ("b", 0.1, 3, 3.0), ("a", 0.1, 4, 4.0)],
    [("a", 2.3, 5, 5.0), ("a", 0.9, 6, 6.0), ("c", 2.0, 7, 7.0)],
    [("b", 4.0, 8, 8.0), ("a", 4.1, 9, 9.0), ("a", 4.05, 10, 10.0), ("c", 4.2, 11, 11.0)],
]
OPERATORS = {
    "latest": (lambda s: live.latest(s, "k", ["at", "n"], ["x"]), "update"),
    "sampled": (lambda s: live.sampled(s.select("k", F.unix_micros("at").cast("double").alias("us"), "n").withColumn("us", F.col("us") / 1e6), "k", "us", "n", 1.0), "append"),
    "capped": (lambda s: live.capped(s, "k", ["at", "n"], 3), "append"),
    "ring": (lambda s: live.ring(s, "k", ["at", "n"], ["x"], 2), "update"),
    "beats": (lambda s: live.heartbeats(s, "k", "at", 0.5), "append"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_restart_changes_nothing(spark, tmp_path, name):
    build, mode = OPERATORS[name]
    told = {}
    for way in ("through", "restarted"):
        folder, out = str(tmp_path / way / "in"), f"file://{tmp_path}/{way}/out"
        for i, rows in enumerate(PARTS):
            time.sleep(0.05)  # files are taken by their time
            feed(spark, folder, f"{i}", rows)
            if way == "restarted":
                told[way] = run(spark, build, folder, out, mode)
        if way == "through":
            told[way] = run(spark, build, folder, out, mode)
    key = lambda r: repr(sorted((k, v) for k, v in r.items() if k != "batch"))
    assert sorted(map(key, told["through"])) == sorted(map(key, told["restarted"])) and told["through"]
    rows = [r for r in told["through"] if r["k"] == "a"]
    if name == "latest":
        assert sorted((r["n"], r["x"], r["dropped"]) for r in rows) == [(2, 2.0, 2), (5, 5.0, 4), (9, 9.0, 6)]
    if name == "sampled":
        assert sorted((r["slot"], r["n"]) for r in rows) == [(0, 1), (2, 5), (4, 10)]  # 6 is of a slot that has its row
    if name == "capped":
        assert sorted((r["position"], r["n"]) for r in rows if r["n"] is not None) == [(0, 1), (1, 4), (2, 2)]
        assert sorted(r["dropped"] for r in rows if r["n"] is None) == [2, 4]
    if name == "ring":
        assert [(r["n"], r["age"]) for r in sorted(rows, key=lambda r: r["age"]) if r["seen"] == 7] == [(9, 0), (10, 1)]
    if name == "beats":
        beats = sorted((r["k"], r["after_us"], r["at_us"]) for r in told["through"])
        want = []
        for k, times in {"a": [0.0, 0.1, 0.2, 0.9, 2.3, 4.05, 4.1], "b": [0.1, 4.0], "c": [2.0, 4.2]}.items():
            us = [round(t * 1e6) for t in times]
            for last, then in zip(us, [*us[1:], None], strict=True):
                at = last + 500_000
                while at < then if then is not None else at <= 4_200_000:
                    want.append((k, last, at))
                    at += 500_000
        assert beats == sorted(want)


def test_no_files_and_ties(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = f"file://{tmp_path}/out"
    feed(spark, str(tmp_path / "in"), "0", [("a", 1.0, 1, 1.0), ("a", 1.0, 1, 1.0), (None, 1.0, 2, None)])
    told = run(spark, OPERATORS["latest"][0], str(tmp_path / "in"), out, "update")
    assert {(r["k"], r["n"], r["x"], r["dropped"]) for r in told} == {("a", 1, 1.0, 1), (None, 2, None, 0)}
    assert run(spark, OPERATORS["latest"][0], str(tmp_path / "in"), out, "update") == told


def test_many_chunks_of_one_key(spark, tmp_path):
    """A key's rows come in several Arrow batches and are still taken in order."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        feed(spark, str(tmp_path / "in"), "0", [("a", float((i * 37) % 100) * 2 + 1, i, float(i)) for i in range(100)])
        for name, want in (("latest", 1), ("sampled", 100), ("capped", 4), ("ring", 2), ("beats", 99 * 3)):
            build, mode = OPERATORS[name]
            told = run(spark, build, str(tmp_path / "in"), f"file://{tmp_path}/{name}", mode)
            assert len(told) == want, name
            if name == "capped":
                assert sorted(r["position"] for r in told if r["position"] is not None) == [0, 1, 2] and {r["n"] for r in told} == {None, 0, 73, 46}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def run_until(spark, build, folder, out, mode, enough, seconds=60):
    """A stream that runs by the clock until what it has told is enough; processing-time state never ends by itself."""
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    with live.rocksdb(spark):
        q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/log").trigger(processingTime="300 milliseconds").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/told/batch={i}")).start()
    try:
        for _ in range(2 * seconds):
            time.sleep(0.5)
            try:
                told = [r.asDict() for r in spark.read.schema(TOLD).parquet(f"{out}/told").collect()]
            except Exception:  # not there yet
                told = []
            if enough(told):
                break
    finally:
        q.stop()
    return told


TOLD = "k string, dropped long, beat long"


def test_state_goes_after_its_time(spark, tmp_path):
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    build = lambda s: live.latest(s, "k", ["at", "n"], ["x"], ttl_ms=500)
    feed(spark, folder, "0", [("a", 0.0, 1, 1.0), ("a", 0.5, 2, 1.0)])
    assert [r["dropped"] for r in run_until(spark, build, folder, out, "update", len)] == [1]
    time.sleep(1.5)
    feed(spark, folder, "1", [("a", 9.0, 3, 1.0)])
    assert sorted(r["dropped"] for r in run_until(spark, build, folder, out, "update", lambda told: len(told) > 1)) == [0, 1]  # else it were 2


def test_live_heartbeats(spark, tmp_path):
    """Silence of the wall clock, while no rows come at all."""
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    feed(spark, folder, "0", [("a", 0.0, 1, 1.0)])
    told = run_until(spark, lambda s: live.heartbeats(s, "k", "at", 0.5, live=True), folder, out, "append", lambda told: len(told) >= 3)
    assert sorted(r["beat"] for r in told) == list(range(1, len(told) + 1)) and len(told) >= 3


def test_clients(spark, tmp_path):
    """Three clients: one steady, one that stalls, one that fails; a publisher that starts anew in between."""
    source, log, places = str(tmp_path / "in"), f"file://{tmp_path}/log", f"file://{tmp_path}/places"
    got = {"steady": [], "stalled": [], "failing": []}

    def sink(name, fails=False):
        def take(frames):
            if fails:
                raise RuntimeError("full")
            got[name] += sorted((r.k, r.n, r.epoch, r.dropped) for r in frames.collect())
        return take

    def publish():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
        clients.publish(stream, log, f"file://{tmp_path}/checkpoint").awaitTermination()

    assert clients.poll(spark, log, places, "steady", "k", ["at", "n"], sink("steady")) == (0, 0)
    for i, rows in enumerate(PARTS):
        feed(spark, source, f"{i}", rows)
        publish()
        told = clients.poll_all(spark, log, places, "k", ["at", "n"], {"failing": sink("failing", i < 2), "steady": sink("steady")})
        assert told == {"failing": "RuntimeError: full" if i < 2 else "ok", "steady": "ok"}
    assert clients.poll(spark, log, places, "stalled", "k", ["at", "n"], sink("stalled")) == (3, 8)
    assert got["steady"] == [("a", 2, 0, 2), ("b", 3, 0, 0), ("a", 5, 1, 1), ("c", 7, 1, 0), ("a", 9, 2, 1), ("b", 8, 2, 0), ("c", 11, 2, 0)]
    assert got["stalled"] == got["failing"] == [("a", 9, 2, 6), ("b", 8, 2, 1), ("c", 11, 2, 1)]
    assert clients.poll(spark, log, places, "stalled", "k", ["at", "n"], sink("stalled")) == (0, 0)
    assert clients.place(spark, places, "steady") == (2, 7, 4) and clients.place(spark, places, "stalled") == (2, 3, 8) and clients.place(spark, places, "new") == (-1, 0, 0)
    # an epoch that is written again replaces itself
    clients.put(spark.createDataFrame(spark.read.parquet(log).where("epoch = 2").drop("epoch").collect(), SCHEMA), 2, log)
    assert spark.read.parquet(log).count() == sum(map(len, PARTS))
