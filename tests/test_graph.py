"""Small graphs with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph as g
from spindrift.operators import normalize as nz


@pytest.fixture(scope="module")
def golden(spark):
    blank = {c: None for c in nz.REQUIRED["annotations"]}
    ann = spark.createDataFrame([blank | {"bodyId": i, "superclass": s, "type": "t"} for i, s in ((30, "b"), (10, "a"), (20, None), (40, "c"))], ", ".join(f"{c} {'long' if c == 'bodyId' else 'string'}" for c in blank))
    nt = spark.createDataFrame([(10, "acetylcholine", None, None, None), (30, "glutamate", None, None, None), (40, "glutamate", None, None, "gaba")], "body long, consensus_nt string, predicted_nt string, predicted_nt_confidence double, ground_truth string")
    con = spark.createDataFrame([(10, 30, 5), (10, 40, 2), (20, 30, 9), (30, 40, 3), (40, 10, 4), (40, 40, 1)], "body_pre long, body_post long, weight long")
    return ann, nt, con


def test_normalization_golden(golden):
    ann, nt, con = golden
    n, e = nz.neurons(ann, nt), nz.edges(con, nz.neuron_map(ann))
    assert [r.body_id for r in n.orderBy("neuron_index").collect()] == [10, 30, 40]
    assert len(n.columns) == 20
    incoming = nz.offsets(e, n).orderBy("node").collect()
    assert [r.start for r in incoming] + [incoming[-1].start + incoming[-1].degree] == [0, 1, 2, 5]
    by_target = e.orderBy("target_index", "source_index").collect()
    assert [r.source_index for r in by_target] == [2, 0, 0, 1, 2] and [r.synapse_count for r in by_target] == [4, 5, 2, 3, 1]
    out = nz.offsets(e, n, "source_index").orderBy("node").collect()
    assert [r.start for r in out] == [0, 2, 3]
    r = nz.report(ann, con, n, e).first()
    assert (r.neuron_count, r.edge_count, r.synaptic_contact_count, r.self_edge_count, r.excluded_annotation_rows, r.excluded_connectivity_rows) == (3, 5, 15, 1, 1, 1)


def test_schema_checks(golden, spark):
    ann, _, con = golden
    with pytest.raises(ValueError):
        nz.check_columns(ann.drop("superclass"), "annotations")
    with pytest.raises(TypeError):
        nz.check_columns(con.withColumn("weight", F.col("weight").cast("int")), "connectivity")
    assert nz.check_columns(ann.withColumn("more", F.lit(1)), "annotations") is not None
    assert nz.dense_index(ann.where("false"), "bodyId").count() == 0


@pytest.fixture(scope="module")
def tiny(spark):
    n = spark.createDataFrame([(0, 10, "sensory", "acetylcholine", None), (1, 20, "interneuron", "Glutamate", "GABA"), (2, 30, "motor", "glutamate", None)], "neuron_index int, body_id long, superclass string, consensus_nt string, ground_truth_nt string")
    e = spark.createDataFrame([(0, 1, 4), (0, 2, 2), (1, 2, 3), (2, 2, 1)], "source_index int, target_index int, synapse_count long")
    return n, e


def test_signs_and_propagation(tiny, spark):
    n, e = tiny
    signs = lambda p: [r.sign for r in g.with_sign(n, p).orderBy("neuron_index").collect()]
    assert signs(g.GLUTAMATE_INHIBITS) == [1, -1, -1] and signs(g.GLUTAMATE_EXCITES) == [1, -1, 1]
    signed = g.with_sign(n)
    act = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 0.0)], "source_index int, activity double")
    assert [r.output for r in g.propagate(signed, e, act).orderBy("neuron_index").collect()] == [0.0, 4.0, -1.0]
    acc = g.accumulate(signed, e, act.where("source_index < 2"))
    assert {r.target_index: r.amount for r in acc.collect()} == {1: 4.0, 2: -1.0} and acc.agg(F.sum("visited")).first()[0] == 3
    proj = g.project(signed, e, spark.createDataFrame([(0,), (1,)], "source_index int"))
    assert {r.target_index: r.weight for r in proj.collect()} == {1: 4, 2: -1}
    with pytest.raises(KeyError):
        g.select(n, nothing=1)
    assert g.select(n, superclass="motor").count() == 1 and g.select(n, superclass="Motor").count() == 0


def test_path_graph(spark):
    e = spark.createDataFrame([(0, 2, 5), (1, 2, 3), (1, 5, 100), (2, 3, 4), (3, 4, 2), (5, 4, 100)], "source_index int, target_index int, synapse_count long")
    n = spark.createDataFrame([(i, 0 if i == 5 else 1) for i in range(6)], "neuron_index int, sign int")
    sources, target = n.where("neuron_index < 2"), n.where("neuron_index = 4")
    layers = g.path_layers(n, e, sources, target, 3)
    got = {}
    for r in layers.collect():
        assert r.length == 3
        got.setdefault(r.layer, set()).add(r.node)
    assert got == {0: {0, 1}, 1: {2}, 2: {3}, 3: {4}}
    between = g.layer_edges(n, e, layers)
    assert sorted((r.hop, r.synapse_count) for r in between.collect()) == [(0, 3), (0, 5), (1, 4), (2, 2)]
    paths = g.ranked_paths(layers, between, 2, 3).orderBy("rank").collect()
    assert [r.nodes for r in paths] == [[0, 2, 3, 4], [1, 2, 3, 4]]
    assert g.upstream_hop(e, sources, target) == 2  # against any sign: 4 <- 5 <- 1


def test_neighborhood_budget(spark):
    e = spark.createDataFrame([(0, 1, 4), (0, 2, 9), (0, 3, 20)], "source_index int, target_index int, synapse_count long")
    got = g.neighborhood(e, [0], max_nodes=3, max_edges=2).collect()
    assert sorted(r.synapse_count for r in got) == [9, 20]
    with pytest.raises(ValueError):
        g.neighborhood(e, [0, 0])
