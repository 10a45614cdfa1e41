"""Whole compositions on tiny inputs."""

import hashlib
import json

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from spindrift import cli
from spindrift.operators import normalize
from spindrift.operators.events import Lif
from spindrift.plans import dataset, experiments
from spindrift.sources import manifest


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    blank = {c: [None] * 4 for c in normalize.REQUIRED["annotations"]}
    tables = {
        "annotations": pa.table(blank | {"bodyId": pa.array([30, 10, 20, 40]), "superclass": ["b", "a", None, "c"]}, schema=pa.schema([(c, pa.int64() if c == "bodyId" else pa.string()) for c in blank])),
        "neurotransmitters": pa.table({"body": [10, 30, 40], "consensus_nt": ["acetylcholine"] * 3, "predicted_nt": pa.array([None] * 3, pa.string()), "predicted_nt_confidence": pa.array([None] * 3, pa.float64()), "ground_truth": pa.array([None] * 3, pa.string())}),
        "connectivity": pa.table({"body_pre": [10, 10, 20, 30, 40, 40], "body_post": [30, 40, 30, 40, 10, 40], "weight": [250, 2, 9, 250, 4, 1]}),
    }
    sources = []
    for role, table in tables.items():
        feather.write_feather(table, str(folder / f"{role}.feather"), compression="uncompressed")
        data = (folder / f"{role}.feather").read_bytes()
        sources.append({"role": role, "filename": f"{role}.feather", "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    text = json.dumps({"dataset": "tiny", "sources": sources, "selection": {"expected_neuron_count": 3}})
    (folder / "m.json").write_text(text)
    out = str(tmp_path_factory.mktemp("out") / "d")
    report = dataset.build(spark, manifest.load(text), str(folder), out)
    return folder, out, report


def test_build_and_validate(spark, built):
    folder, out, report = built
    r = report.first()
    assert (r.neuron_count, r.edge_count, r.self_edge_count, r.excluded_connectivity_rows, r.dataset) == (3, 5, 1, 1, "tiny")
    assert {x.part: x.ok for x in dataset.validate(spark, out).collect()} == {"neurons": True, "edges": True}
    with pytest.raises(Exception):
        dataset.build(spark, manifest.load((folder / "m.json").read_text()), str(folder), out)
    spark.read.parquet(f"{out}/edges").limit(4).write.parquet(f"{out}-changed/edges")
    spark.read.parquet(f"{out}/neurons").write.parquet(f"{out}-changed/neurons")
    spark.read.json(f"{out}/lock").write.json(f"{out}-changed/lock")
    assert {x.part: x.ok for x in dataset.validate(spark, f"{out}-changed").collect()} == {"neurons": True, "edges": False}


def test_command_line(spark, built, capsys):
    folder, out, _ = built
    assert cli.main(["verify", "--manifest", str(folder / "m.json"), "--sources", str(folder)]) == 0
    assert cli.main(["validate", "--out", out]) == 0
    assert '"edges": true' in capsys.readouterr().out


def test_localize(spark, built):
    data = dataset.load(spark, built[1])
    out = experiments.localize(data, data.neurons.where("neuron_index = 0"), data.neurons.where("neuron_index = 2"), 2)
    assert [r.nodes for r in out["paths"].collect()] == [[0, 2]] and out["watch"].count() == 1


def test_characterize(spark, built):
    data = dataset.load(spark, built[1])
    inputs = data.neurons.where("neuron_index = 0").select(F.lit("in").alias("key"), "neuron_index")
    outputs = data.neurons.where("neuron_index > 0").select(F.lit("out").alias("key"), "neuron_index")
    plan = experiments.Characterization((12.0,), (20.0,), 2, 0.002, 0.03, 0.005)
    out = experiments.characterize(data, inputs, outputs, plan, Lif())
    assert out["conditions"].count() == 4 and all(r.agree for r in out["repeats"].collect())
    responses = {r.population: r for r in out["responses"].collect()}
    assert responses["in-a12-d20ms-r0|out"].stimulus_spikes > 0 and responses["control-r0|out"].no_response


def test_loop_and_vision(spark):
    starts = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.5, 0.5), (2, 1.0, 0.0)], "episode long, x double, y double")
    path = experiments.closed_loop(starts, lambda dx, dy: (dx, dy), (0.6, 0.4))
    last = {r.episode: r.d for r in path.groupBy("episode").agg(F.max_by("distance", "step").alias("d")).collect()}
    assert max(last.values()) <= 0.07
    from spindrift.operators.signals import EarlyVision

    frames = spark.createDataFrame([(c, f, 0.5 if f < 2 or c == 0 else 0.9) for c in range(2) for f in range(5)], "channel long, frame long, luminance double")
    drives = experiments.early_vision(frames, EarlyVision(frame_rate_hz=100.0), 6.0, 1e-6, 1.0, 1.8)
    assert {r.label for r in drives.select("label").distinct().collect()} == {"l1-1", "l2-1", "l3-1"}


def test_decode_axis(spark):
    rows = [(i, [float(i), 1.0, (i * 7 % 5) / 5], [float(i % 2)], i / 10, True) for i in range(10)]
    samples = spark.createDataFrame(rows, "row long, a array<double>, b array<double>, target double, train boolean")
    best = experiments.decode_axis(samples, {"good": "a", "poor": "b"}, (0.01, 1.0), (1, 2)).first()
    assert best.modality == "good" and best.score < 0.1


def test_index_outgoing(spark, built, tmp_path, monkeypatch, capsys):
    """Written beside, checked, visible by one rename; a failed one stays partial and unseen; an existing one isn't touched."""
    import shutil

    from spindrift.operators import offsets

    out = str(tmp_path / "d")
    shutil.copytree(built[1], out)
    before = sorted(p.name for p in (tmp_path / "d").iterdir())
    # a fault between the write and the rename
    monkeypatch.setattr(dataset.storage, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        dataset.index_outgoing(spark, out)
    monkeypatch.undo()
    left = [p.name for p in (tmp_path / "d").iterdir() if p.name not in before]
    assert len(left) == 1 and left[0].startswith("_outgoing.partial-")
    # edges that the written orientation lacks
    whole = offsets.write
    monkeypatch.setattr(dataset.offsets, "write", lambda edges, *a: whole(edges.where("source_index <> 0"), *a))
    with pytest.raises(ValueError, match="differ"):
        dataset.index_outgoing(spark, out)
    monkeypatch.undo()
    assert not (tmp_path / "d" / "outgoing").exists()
    # and the good one
    assert cli.main(["index-outgoing", "--out", out]) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert told["in_edges"] == told["out_edges"] == 5 and told["edges_apart"] == told["nodes_apart"] == 0
    rows = spark.read.parquet(f"{out}/outgoing/edges").collect()
    assert [(r.source_index, r.target_index) for r in rows] == sorted((r.source_index, r.target_index) for r in rows) and len(rows) == 5
    assert {(r.node, r.degree, r.start) for r in spark.read.parquet(f"{out}/outgoing/offsets").collect()} == {(0, 2, 0), (1, 1, 2), (2, 2, 3)}
    with pytest.raises(FileExistsError):
        dataset.index_outgoing(spark, out)
    assert {x.part: x.ok for x in dataset.validate(spark, out).collect()} == {"neurons": True, "edges": True}
