"""Requests, registries and documents."""

import pytest

from spindrift.plans import config
from spindrift.plans.config import Experiment, Registry, parse
from spindrift.queries.streams import run_to_end
from spindrift.sources import artifacts
from spindrift.streaming import telemetry


def test_bounds():
    assert parse(Experiment, {"duration_s": 2.0, "stimulus": {"neuron_indices": [3, 1]}, "populations": [{"name": "a b", "neuron_indices": [1]}]}).stimulus.neuron_indices == (3, 1)
    for bad in ({"duration_s": 100.0}, {"surplus": 1}, {"watch_indices": [1, 1]}, {"watch_indices": list(range(33))}, {"stimulus": {"start_s": 0.2, "stop_s": 0.1}}, {"populations": [{"name": "?", "neuron_indices": [1]}]}, {"duration_s": 0.01}, {"populations": [{"name": "a", "neuron_indices": [1]}] * 2}):
        with pytest.raises(ValueError):
            parse(Experiment, bad)
    assert config.BOUNDS["seeds"] == 64


def test_registry():
    r = Registry()
    r.register("plain", lambda x=1: x + 1)
    assert r.build(None) is None and r.build("plain", x=2) == 3
    with pytest.raises(KeyError):
        r.build("other")
    with pytest.raises(ValueError):
        r.register("plain", int)


def test_documents(spark, tmp_path):
    artifacts.run_manifest(spark, str(tmp_path / "run"), seed=3)
    assert artifacts.read_document(spark, str(tmp_path / "run"))["seed"] == 3
    with pytest.raises(Exception):
        artifacts.run_manifest(spark, str(tmp_path / "run"))
    artifacts.write_rows(spark.createDataFrame([(2**60 + 1, 5)], "body_id long, n long"), str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).first().body_id == str(2**60 + 1)


def test_session_stream(spark, tmp_path):
    actions = ["start", "pause", "start", "resume", "finish", "reset"]
    rows = [(f"s{k}", i, a) for k in range(3) for i, a in enumerate(actions)]
    spark.createDataFrame(rows, "session string, seq long, action string").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, seq long, action string").parquet(str(tmp_path / "in"))
    got = run_to_end(telemetry.session_stream(stream), spark)
    batch = telemetry.session_states(spark.createDataFrame(rows, "session string, seq long, action string"), ["session"], ["seq"])
    assert sorted((r.session, r.seq, r.state, r.legal) for r in got.collect()) == sorted((r.session, r.position, r.state, r.legal) for r in batch.collect())


def test_fan_out(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    seen = {"a": 0, "b": 0}

    def sink(name):
        def take(batch, number):
            seen[name] += batch.count()

        return take

    artifacts.fan_out(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), [sink("a"), sink("b")], str(tmp_path / "log")).awaitTermination()
    assert seen == {"a": 10, "b": 10}
