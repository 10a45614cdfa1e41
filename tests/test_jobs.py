"""The two jobs: results against SQL, growing input, reruns, broken rows."""

import json
import logging
import os

import duckdb
import pytest

from jobs import common, goal_log, graph_dataset
from jobs import queries as jobs
from spindrift.operators import storage
from tests.test_queries import rows

GOALS = json.load(open(goal_log.CONFIG))
GRAPH = json.load(open(graph_dataset.CONFIG))
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_against_sql(spark, duck, sf, name):
    before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}
    got, want = jobs.queries()[name](spark, sf).toPandas(), duck.sql(jobs.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)
    assert {k: v for k, v in spark.conf.getAll.items() if k in before} == before


def told(spark, table):
    return sorted((r.session, r.step, r.author, r.goal, r.batch) for r in table.collect())


def put(spark, folder, turns):
    spark.createDataFrame(turns, TURNS).coalesce(1).write.mode("append").parquet(f"{folder}/conversations.parquet")


def test_goal_log_takes_only_what_is_new(spark, tmp_path, caplog):
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    caplog.set_level(logging.INFO, "spindrift.jobs")
    put(spark, source, [(1, 0, "user", " Move  LEFT\n"), (1, 1, "assistant", "ok"), (1, 0, "user", "move up"), (None, 0, "user", "x"), (1, None, "user", "x"), (2, 0, "robot", "x"), (2, 1, None, "x"), (2, 2, "user", " \n"), (2, 3, "user", None)])
    first = told(spark, goal_log.run(spark, source, out, GOALS))
    assert first == [(1, 0, "user", "move left", 0), (1, 1, "assistant", "ok", 0)]
    assert "read batch 0: 9 rows" in caplog.text
    rejected = {(r.session, r.step, r.reason): r.rows for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert rejected == {(None, 0, "no session"): 1, (1, None, "no step"): 1, (2, 0, "author"): 1, (2, 1, "author"): 1, (2, 2, "no text"): 1, (2, 3, "no text"): 1}
    # nothing new: nothing changes
    files = sorted(p.name for p in (tmp_path / "out" / "turns").rglob("*.parquet"))
    assert told(spark, goal_log.run(spark, source, out, GOALS)) == first
    assert sorted(p.name for p in (tmp_path / "out" / "turns").rglob("*.parquet")) == files
    # new files: a turn that comes again stays as it was, a new one is added
    put(spark, source, [(1, 0, "user", "another goal"), (3, 0, "system", "Straße"), (3, 0, "system", "Straße")])
    caplog.clear()
    second = told(spark, goal_log.run(spark, source, out, GOALS))
    assert second == [*first, (3, 0, "system", "strasse", 1)]
    assert "read batch 1: 3 rows" in caplog.text and "read batch 0" not in caplog.text


def test_goal_log_batches_are_repeatable(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    frame = lambda *turns: spark.createDataFrame(list(turns), TURNS)
    goal_log.take(frame((1, 0, "user", "a")), 0, out, GOALS)
    for _ in range(2):  # a batch that died after its write comes again
        goal_log.take(frame((1, 0, "user", "b"), (1, 1, "user", "c")), 1, out, GOALS)
    read = lambda: told(spark, spark.read.schema(goal_log._TURNS).parquet(f"{out}/turns"))
    assert read() == [(1, 0, "user", "a", 0), (1, 1, "user", "c", 1)]
    # a new checkpoint begins at batch 0 and leaves nothing of the old log
    goal_log.take(frame((5, 0, "user", "z")), 0, out, GOALS)
    assert read() == [(5, 0, "user", "z", 0)]


def test_goal_log_by_files_and_at_once_agree(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(5):
        put(spark, source, [(i, k, "user", f"Goal {i} {k}") for k in range(4)])
    one = told(spark, goal_log.run(spark, source, f"file://{tmp_path}/a", GOALS))
    many = told(spark, goal_log.run(spark, source, f"file://{tmp_path}/b", GOALS | {"files_per_batch": 1}))
    assert [r[:4] for r in one] == [r[:4] for r in many] and len({r[4] for r in many}) == 5


def test_goal_log_without_files(spark, tmp_path):
    (tmp_path / "in" / "conversations.parquet").mkdir(parents=True)
    assert told(spark, goal_log.run(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", GOALS)) == []


def raw(spark, folder, bodies, connections, transmitters=()):
    spark.createDataFrame(list(bodies), "id long, kind string").write.mode("overwrite").parquet(f"{folder}/bodies")
    spark.createDataFrame(list(transmitters), "id long, nt string").write.mode("overwrite").parquet(f"{folder}/nts")
    spark.createDataFrame(list(connections), "a long, b long, n long").write.mode("overwrite").parquet(f"{folder}/links")
    tables = {"annotations": ("bodies", ["id AS bodyId", "kind AS superclass"]), "neurotransmitters": ("nts", ["id AS body", "nt AS consensus_nt"]), "connectivity": ("links", ["a AS body_pre", "b AS body_post", "n AS weight"])}
    return GRAPH | {"tables": {k: {"path": p, "select": s} for k, (p, s) in tables.items()}, "block": 2}


def test_graph_dataset(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "spindrift.jobs")
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    settings = raw(spark, source, [(10, "x"), (20, "y"), (30, "x"), (40, None)], [(10, 20, 3), (10, 20, 1), (30, 20, 4), (20, 10, 2), (40, 10, 9), (99, 10, 1), (None, 10, 1), (10, None, 1), (10, 30, 0), (10, 30, None), (20, 20, 1)], [(10, "GABA"), (20, "acetylcholine")])
    want = [(0, 1, 4, -4, 4 / 9, 0), (1, 0, 2, 2, 1.0, 0), (1, 1, 1, 1, 1 / 9, 0), (2, 1, 4, 0, 4 / 9, 0)]
    for _ in range(2):
        edges = graph_dataset.run(spark, source, out, settings)
        assert sorted(tuple(r) for r in edges.collect()) == want
        nodes = sorted((r.neuron_index, r.body_id, r.sign, r.in_edges, r.out_edges, r.superclass) for r in spark.read.parquet(f"{out}/neurons").collect())
        assert nodes == [(0, 10, -1, 1, 1, "x"), (1, 20, 1, 3, 2, "y"), (2, 30, 0, 0, 1, "x")]
        rejected = {(r.body_pre, r.body_post): (r.reason, r.rows) for r in spark.read.parquet(f"{out}/rejected").collect()}
        assert rejected == {(40, 10): ("outside of the census", 1), (99, 10): ("outside of the census", 1), (None, 10): ("no end", 1), (10, None): ("no end", 1), (10, 30): ("weight", 2)}
    assert "read annotations: 4 rows" in caplog.text and "read connectivity: 11 rows" in caplog.text and "wrote edges: 4 rows, 11 contacts" in caplog.text
    # less input: what is gone from it is gone from the dataset too
    settings = raw(spark, source, [(10, "x"), (20, "x")], [(10, 20, 1)])
    assert [tuple(r) for r in graph_dataset.run(spark, source, out, settings).collect()] == [(0, 1, 1, 0, 1.0, 0)]
    assert {r.superclass for r in spark.read.parquet(f"{out}/neurons").collect()} == {"x"}


def test_graph_dataset_on_odd_input(spark, tmp_path):
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    assert graph_dataset.run(spark, source, out, raw(spark, source, [], [])).count() == 0
    assert graph_dataset.run(spark, source, out, raw(spark, source, [(1, "x")], [])).count() == 0
    with pytest.raises(ValueError, match="repeated"):
        graph_dataset.run(spark, source, out, raw(spark, source, [(1, "x"), (1, "y")], []))
    with pytest.raises(ValueError, match="null"):
        graph_dataset.run(spark, source, out, raw(spark, source, [(None, "x")], []))
    odd = raw(spark, source, [(1, "x")], [])
    odd["tables"]["annotations"]["select"].append("kind AS nonsense")
    with pytest.raises(ValueError, match="nonsense"):
        graph_dataset.run(spark, source, out, odd)


def test_edges_of_a_block_are_a_pruned_read(spark, sf, tmp_path):
    edges = graph_dataset.run(spark, sf, f"file://{tmp_path}/out", GRAPH | {"block": 16})
    plan = edges.where("target_block = 2 and target_index = 35")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(target_block" in plan and "EqualTo(target_index,35)" in plan
    assert edges.select("target_block").distinct().count() > 3


def test_command_lines(spark, tmp_path, sf, monkeypatch):
    """The command line reads its config through Spark, runs and stops its session (here: not)."""
    stopped = []
    monkeypatch.setattr(type(spark), "stop", lambda self: stopped.append(1))
    for module in (goal_log, graph_dataset):
        monkeypatch.setattr(module, "start", lambda app: spark)
        module.main(["--input", sf, "--output", f"file://{tmp_path}/{module.__name__}"])
    assert len(stopped) == 2 and storage.exists(spark, f"file://{tmp_path}/jobs.goal_log/turns")
    bad = tmp_path / "bad.json"
    bad.write_text("{}")
    with pytest.raises(ValueError, match="lacks"):
        common.config(spark, f"file://{bad}", ("path",))


def test_nothing_of_the_removable_parts():
    for name in os.listdir("jobs"):
        if name.endswith(".py"):
            text = open(os.path.join("jobs", name)).read()
            assert "spindrift.llm" not in text and "corpus_pipeline" not in text
