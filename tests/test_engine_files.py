"""Graphs as files, the engine against its plain twin and its joins, readers, sinks, bounds and the driver entry's guard."""

import random
import shutil
import subprocess
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spindrift.functions import scalars
from spindrift.operators import events, reference, storage
from spindrift.plans import config
from spindrift.sources import files
from spindrift.streaming import telemetry


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(50)})
    return events.Adjacency.of(12, [a for a, _ in pairs], [b for _, b in pairs], [rng.randrange(60, 300) for _ in pairs], [rng.choice([1, 1, -1, 0]) for _ in range(12)])


def test_arrays_as_files(graph, tmp_path):
    folder = str(tmp_path / "g")
    graph.write(folder)
    back = events.Adjacency.open(folder)
    for name in ("start", "target", "count", "sign"):
        np.testing.assert_array_equal(getattr(back, name), getattr(graph, name))
    assert isinstance(back.target, np.memmap) and back.n == 12
    into, again = np.zeros(12), np.zeros(12)
    assert graph.accumulate(np.array([0, 3]), into, 0.5) == back.accumulate(np.array([0, 3]), again, 0.5) and (into == again).all()
    with pytest.raises(FileExistsError):
        graph.write(folder)
    for name, broken in (("start", graph.start[:-1]), ("start", graph.start[::-1].copy()), ("target", graph.target + 12), ("count", graph.count * 0), ("sign", graph.sign + 5), ("target", graph.target.astype(float))):
        bad = str(tmp_path / "bad")
        shutil.copytree(folder, bad)
        np.save(f"{bad}/{name}.npy", broken)
        with pytest.raises(ValueError):
            events.Adjacency.open(bad)
        shutil.rmtree(bad)


def test_engine_against_plain_rules(graph):
    pulses = {10: [0, 3, 5], 30: [1], 31: [2, 3], 60: [0, 7, 8, 9]}
    for settings in (events.Lif(), events.Lif(delay=0.0), events.Lif(refractory=0.0, bias=1.0)):
        gap = reference.difference(graph, pulses, 300, 12.0, settings)
        assert gap["spikes_apart"] == 0 and gap["max_v"] < 1e-9 and gap["max_g"] < 1e-9
    assert len(reference.run(graph, pulses, 300, 12.0).spikes) > 8


def test_run_by_joins(spark, graph):
    n = spark.createDataFrame([(i, int(graph.sign[i])) for i in range(12)], "neuron_index int, sign int")
    owner = np.repeat(np.arange(12), np.diff(graph.start))
    e = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(owner, graph.target, graph.count, strict=True)], "source_index int, target_index int, synapse_count long")
    pulses = {2: [0, 3, 5], 4: [1]}
    p = spark.createDataFrame([(t, i) for t, m in pulses.items() for i in m], "step int, neuron_index int")
    short = events.Lif(delay=0.3, refractory=0.4)
    state, spikes = events.run_by_joins(n, e, p, 9, short, 12.0)
    sim = events.Simulator(graph, short)
    own = sim.fresh()
    out = sim.advance(own, 0.0009, {k: np.array(m) for k, m in pulses.items()}, 12.0)
    assert sorted((r.step, r.neuron_index) for r in spikes.collect()) == out["events"] and len(out["events"]) >= 3
    rows = sorted(state.collect(), key=lambda r: r.neuron_index)
    np.testing.assert_allclose([r.v for r in rows], own.v, atol=1e-9)
    np.testing.assert_allclose([r.g for r in rows], own.g, atol=1e-9)


def test_checks_of_drives_and_populations(graph):
    sim = events.Simulator(graph)
    sim.prepare()
    state = sim.fresh()
    sim.advance(state, 0.002, {3: np.array([0, 1])}, 12.0)
    assert state.on_their_way == sum(map(len, state.pending.values())) and state.seconds(sim.config) == pytest.approx(0.002)
    good = events.Drive(np.array([1, 2]), np.array([1.0, 2.0]), np.ones(5))
    sim.check([good], {"a": (1, 2)})
    for drives, populations in (([events.Drive(np.array([1]), np.ones(2), np.ones(5))], {}), ([events.Drive(np.array([12]), np.ones(1), np.ones(5))], {}), ([events.Drive(np.array([1]), np.ones(1), np.array([np.nan]))], {}), ([], {"a": ()}), ([], {"a": (1, 1)}), ([], {"a": (12,)})):
        with pytest.raises(ValueError):
            sim.check(drives, populations)


def test_vectors(spark, tmp_path):
    (tmp_path / "v.csv").write_text("p,q,x,y,z\n1,-2,0.5,0,1e-3\n")
    (tmp_path / "s.csv").write_text("side,raw_p,raw_q,x,y,z\nL,3,4,1,2,3\n")
    assert [tuple(r) for r in files.vectors(spark, str(tmp_path / "v.csv")).collect()] == [(None, 1, -2, 0.5, 0.0, 1e-3)]
    assert files.vectors(spark, str(tmp_path / "s.csv"), sided=True).first().side == "L"
    (tmp_path / "e.csv").write_text("p,q,x,y,z\n")
    with pytest.raises(ValueError):
        files.vectors(spark, str(tmp_path / "e.csv"))
    (tmp_path / "b.csv").write_text("p,q,x,y,z\n1,2,a,0,0\n")
    with pytest.raises(Exception, match="CAST|malformed"):
        files.vectors(spark, str(tmp_path / "b.csv")).collect()


def test_settings():
    assert config.memory_limit("512MB") == "512MB" and config.sql_text("a'b") == "'a''b'"
    for bad in ("0GB", "4gb", "4 GB", "", "GB", "1.5GB"):
        with pytest.raises(ValueError):
            config.memory_limit(bad)


def test_recordings(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    got = [tuple(r) for r in telemetry.recording_catalog(spark, str(tmp_path), {"one": "a.json", "two": "b.json"}).collect()]
    assert got == [("one", "a.json", True), ("two", "b.json", False)]
    point = F.struct(F.lit(0.1).alias("x"), F.lit(0.2).alias("y"))
    for recording, episode, step in (("other", 0, 0), ("factorized-2d", 64, 0), ("factorized-2d", 0, 4096), (None, 0, 0)):
        rows = spark.createDataFrame([(recording, episode, step, 1.0, 0.5)], "recording string, episode int, step int, distance_before double, distance_after double")
        with pytest.raises(Exception, match="bounds"):
            telemetry.recorded_steps(rows.withColumns({"before": point, "after": point, "target": point})).collect()


def test_sorted_tables_and_publishing(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.write_sorted(spark.range(5000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(10**6))), f"{path}.partial", "k", partitions=2, group_rows=1000)
    parts = sorted(p for p in (tmp_path / "t.partial").iterdir() if p.suffix == ".parquet")
    values = [pq.read_table(p).column("k").to_pylist() for p in parts]
    assert [x for v in values for x in v] == sorted(x for v in values for x in v)
    assert all(pq.ParquetFile(p).metadata.row_group(0).num_rows == 1000 for p in parts)
    storage.publish(spark, f"{path}.partial", path)
    assert spark.read.parquet(path).count() == 5000 and not (tmp_path / "t.partial").exists()
    with pytest.raises(FileExistsError):
        storage.publish(spark, path, path)


def test_case_folding(spark):
    texts = ["Straße  Ελλάς\tſ", "ŉ ǰ ΐ", "İstanbul", "ﬁne ᏸ K", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.normalized_goal(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == [" ".join(t.casefold().split()) for t in texts]


def test_entry_says_what_is_missing(tmp_path):
    """Without the llm folders the rest works; another missing module is an error."""
    root = str(tmp_path / "repo")
    shutil.copytree(".", root, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=100)
    with open(f"{root}/spindrift/llm/urls.py", "a") as f:
        f.write("\nimport no_such_module_here\n")
    assert "no_such_module_here" in run().stderr
    shutil.rmtree(f"{root}/spindrift/llm")
    assert int(run().stdout) > 150
    (tmp_path / "repo" / "corpus_pipeline.py").unlink()
    assert int(run().stdout) > 150


def test_budgets(graph):
    sim = events.Simulator(graph)
    pulses = {k: np.arange(12) for k in range(5, 300, 40)}
    run = lambda **limits: events.run_budgeted(sim, sim.fresh(), 0.03, 0.003, events.Budgets(**limits), pulses, 12.0)
    whole = run()
    assert whole["stop"] is None and whole["steps"] == 300 and whole["spikes"] > 12
    few = run(spikes=3)
    assert few["stop"] == "spikes" and 3 < few["spikes"] <= whole["spikes"] and few["steps"] % 30 == 0 and few["steps"] < 300
    assert run(spikes=0, wall_s=0.0)["stop"] == "wall_s" and run(memory_mb=0.1, spikes=10**6)["stop"] == "memory_mb"
    state = sim.fresh()
    state.v[0] = np.nan
    assert events.run_budgeted(sim, state, 0.03, 0.003, events.Budgets(wall_s=0.0))["stop"] == "non_finite"


def test_limits_of_pixel_files(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.zeros((3, 4, 5)))
    path = str(tmp_path / "f.npy")
    assert files.pixel_frames(spark, path).count() == 60
    for limits in ({"most_frames": 2}, {"most_pixels": 19}):
        with pytest.raises(Exception, match="beyond the limits"):
            files.pixel_frames(spark, path, **limits).count()


def test_correlation_that_must_be_finite(spark):
    from spindrift.operators import metrics

    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    with pytest.raises(Exception, match="not finite"):
        rows.agg(metrics.finite_correlation(F.col("x"), F.col("y"))).collect()
