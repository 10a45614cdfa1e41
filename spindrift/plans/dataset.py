"""From raw source files to a validated, published graph dataset, and back."""

from __future__ import annotations

from dataclasses import dataclass

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import graph, normalize, offsets, storage
from spindrift.sources import arrow_ipc, manifest


@dataclass(frozen=True)
class Dataset:
    """A published dataset: neurons with signs, and edges."""

    neurons: DataFrame
    edges: DataFrame

    def select(self, **exact) -> DataFrame:
        return graph.select(self.neurons, **exact)

    def propagate(self, activity: DataFrame) -> DataFrame:
        return graph.propagate(self.neurons, self.edges, activity)

    def accumulate(self, events: DataFrame) -> DataFrame:
        return graph.accumulate(self.neurons, self.edges, events)

    def project(self, sources: DataFrame) -> DataFrame:
        return graph.project(self.neurons, self.edges, sources)

    def induce(self, members: DataFrame) -> DataFrame:
        return graph.induced(self.edges, members)


#: Rows of a row group of each table. Fixed values.
NEURON_GROUP, EDGE_GROUP = 262_144, 1_048_576


def build(spark: SparkSession, description: manifest.Manifest, folder: str, out: str) -> DataFrame:
    """Verify the source files, normalize, write out/neurons, out/edges, out/report and out/lock; the report.

    Each table is written once, sorted, in row groups of a fixed size, and all of them are published by one
    rename; existing output raises, and a failed build leaves its partial folder. The census must have the manifest's
    expected size, if it names one.
    """
    final, out = out, f"{out}.partial-{uuid.uuid4().hex}"
    manifest.require(manifest.verify(spark, description, folder))
    ann, nts, con = (normalize.check_columns(arrow_ipc.read(spark, f"{folder}/{description.artifact(role).filename}", normalize.REQUIRED[role]), role) for role in manifest.ROLES)
    for df, key in ((ann, "bodyId"), (nts, "body")):
        found = normalize.check_unique_ids(df, key).first()
        if found.null_ids or found.duplicate_ids:
            raise ValueError(f"{key}: {found.null_ids} null and {found.duplicate_ids} repeated ids")
    storage.write_sorted(normalize.neurons(ann, nts), f"{out}/neurons", "neuron_index", group_rows=NEURON_GROUP)
    neurons = spark.read.parquet(f"{out}/neurons")
    if description.expected_neurons is not None and neurons.count() != description.expected_neurons:
        raise ValueError(f"{neurons.count()} neurons, {description.expected_neurons} expected")
    edges = normalize.checked_edges(normalize.edges(con, neurons.select("body_id", "neuron_index")))
    storage.write_sorted(edges, f"{out}/edges", "target_index", "source_index", group_rows=EDGE_GROUP)
    edges = spark.read.parquet(f"{out}/edges")
    wrong = normalize.edge_order_violations(edges).first()
    if wrong.duplicate_pairs or wrong.bad_weights:
        raise ValueError(f"{wrong.duplicate_pairs} repeated pairs, {wrong.bad_weights} bad weights")
    report = normalize.report(ann, con, neurons, edges).withColumn("dataset", F.lit(description.dataset))
    report.coalesce(1).write.json(f"{out}/report")
    locks = normalize.content_lock(neurons).withColumn("part", F.lit("neurons")).unionByName(normalize.content_lock(edges).withColumn("part", F.lit("edges")))
    locks.coalesce(1).write.json(f"{out}/lock")
    storage.publish(spark, out, final)
    return spark.read.json(f"{final}/report")


def index_outgoing(spark: SparkSession, out: str) -> DataFrame:
    """Add out/outgoing, the edges by source, to a published dataset, with offsets; one row on how both orientations compare.

    It is written beside the dataset, checked against the incoming edges and against its own order, and becomes visible by one
    rename. An existing one raises and stays; one that fails a check, or whose run dies, stays partial and unseen.
    """
    final = f"{out}/outgoing"
    if storage.exists(spark, final):
        raise FileExistsError(final)
    partial = f"{out}/_outgoing.partial-{uuid.uuid4().hex}"
    edges = spark.read.parquet(f"{out}/edges")
    offsets.write(edges, partial, offsets.OUT)
    found = normalize.orientation_check(edges, spark.read.parquet(f"{partial}/edges"))
    told = found.first()
    if told.edges_apart or told.nodes_apart or told.in_edges != told.out_edges:
        raise ValueError(f"outgoing edges differ: {told.asDict()}")
    storage.publish(spark, partial, final)
    return spark.createDataFrame([told], found.schema)


def validate(spark: SparkSession, out: str) -> DataFrame:
    """(part, ok): whether each table's content is what its lock says, whatever files hold it."""
    want = spark.read.schema("rows long, content string, part string").json(f"{out}/lock")
    have = None
    for part in ("neurons", "edges"):
        row = normalize.content_lock(spark.read.parquet(f"{out}/{part}")).withColumn("part", F.lit(part))
        have = row if have is None else have.unionByName(row)
    return want.alias("w").join(have.alias("h"), "part").select("part", ((F.col("w.rows") == F.col("h.rows")) & (F.col("w.content") == F.col("h.content"))).alias("ok"))


def load(spark: SparkSession, out: str, policy=graph.GLUTAMATE_INHIBITS) -> Dataset:
    return Dataset(graph.with_sign(spark.read.parquet(f"{out}/neurons"), policy), spark.read.parquet(f"{out}/edges"))
