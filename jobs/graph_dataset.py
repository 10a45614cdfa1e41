"""Raw tables of bodies, transmitters and connections to a signed, partitioned graph dataset.

    python -m jobs.graph_dataset --input /data/raw --output /data/graph [--config jobs/graph_dataset.json]

Whoever studies the graph starts from three raw tables and needs dense indices, signs and, for each connection, its share
of what its target receives. The job writes

* neurons/ (partitioned by superclass): the census with neuron_index, annotations, transmitters, sign, in_edges, out_edges;
* edges/ (partitioned by target_block, `block` indices each): source_index, target_index, synapse_count, signed_count,
  input_share, sorted by target and source within a file, so that a block's or a target's edges are a pruned read;
* rejected/ (partitioned by reason): connections that lack an end, have no positive 32-bit weight, or an end outside of the census.

A rerun writes the same rows over the old ones. Broken ids (null or repeated bodies) raise before anything is written.
The config names each table's path below the input, its columns as SQL expressions and, if need be, a filter, the sign of each transmitter and the width of a block.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, start, twice
from spindrift.operators import graph, normalize, storage

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "graph_dataset.json")
_EDGES = "source_index int, target_index int, synapse_count long, signed_count long, input_share double, target_block int"
_REJECTED = "body_pre long, body_post long, rows long, weight long, reason string"
_TYPES = {"bodyId": "long", "body": "long", "body_pre": "long", "body_post": "long", "weight": "long", "predicted_nt_confidence": "double"}


def raw(spark: SparkSession, source: str, role: str, said: dict) -> DataFrame:
    """A raw table with the columns its role needs; those that the config doesn't name are null."""
    table = spark.read.parquet(f"{source}/{said['path']}")
    chosen = (table.where(said["where"]) if said.get("where") else table).selectExpr(*said["select"])
    unknown = set(chosen.columns) - set(normalize.REQUIRED[role])
    if unknown:
        raise ValueError(f"{role} has no columns {', '.join(sorted(unknown))}")
    return chosen.select(*[(F.col(c) if c in chosen.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in normalize.REQUIRED[role]])


def _side(written: DataFrame) -> DataFrame:
    """A written table as the smaller side of a join: broadcast up to a million rows, else merged, as its packed files say little of its size."""
    side = storage.bounded(written)
    return written.hint("merge") if side is written else side


def run(spark: SparkSession, source: str, out: str, settings: dict) -> DataFrame:
    """Build the dataset at out from the tables below source; the edges as they stand then."""
    tables = {role: raw(spark, source, role, settings["tables"][role]) for role in ("annotations", "neurotransmitters", "connectivity")}
    for role, key in (("annotations", "bodyId"), ("neurotransmitters", "body")):
        ids = normalize.check_unique_ids(tables[role], key).first()
        log.info("read %s: %d rows", role, ids.rows)
        if ids.null_ids or ids.duplicate_ids:
            raise ValueError(f"{role}: {ids.null_ids} null and {ids.duplicate_ids} repeated ids")

    census = graph.with_sign(normalize.neurons(tables["annotations"], tables["neurotransmitters"]), settings["signs"])
    census = storage.materialize(census.withColumn("spread", F.lit(0)), "job1-census")
    sound = F.coalesce(F.col("weight").between(1, normalize.INT_MAX), F.lit(False))
    placed = tables["connectivity"].groupBy("body_pre", "body_post", sound.alias("sound")).agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))
    for c, other, names in (("body_pre", "body_post", {"neuron_index": "source_index", "sign": "sign"}), ("body_post", "body_pre", {"neuron_index": "target_index"})):
        # ends that are null would all meet in one task of the join: they are spread by the other end, over values that no body has
        placed = placed.withColumns({"body_id": F.coalesce(c, F.lit(0)), "spread": F.when(F.col(c).isNull(), F.pmod(F.xxhash64(other), F.lit(4096)).cast("int") + 1).otherwise(0)})
        placed = placed.join(_side(census.select("body_id", "spread", *[F.col(a).alias(b) for a, b in names.items()])), ["body_id", "spread"], "left").drop("body_id", "spread")
    reason = F.when(F.col("body_pre").isNull() | F.col("body_post").isNull(), "no end").when(~F.col("sound"), "weight").when(F.col("source_index").isNull() | F.col("target_index").isNull(), "outside of the census")
    placed = storage.materialize(placed.withColumn("reason", reason), "job1-placed")

    log.info("read connectivity: %d rows", placed.agg(F.sum("rows")).first()[0] or 0)
    rejected = placed.where("reason is not null").select("reason", "body_pre", "body_post", "rows", "weight")
    rejected.write.mode("overwrite").partitionBy("reason").parquet(f"{out}/rejected")
    pairs = placed.where("reason is null").select("source_index", "target_index", "sign", F.col("weight").alias("synapse_count"))
    received = storage.materialize(pairs.groupBy("target_index").agg(F.sum("synapse_count").alias("received"), F.count("*").alias("in_edges")), "job1-received")
    edges = pairs.join(_side(received.select("target_index", "received")), "target_index").select(
        "source_index", "target_index", "synapse_count", (F.col("synapse_count") * F.col("sign")).alias("signed_count"), (F.col("synapse_count") / F.col("received")).alias("input_share"),
        F.floor(F.col("target_index") / settings["block"]).cast("int").alias("target_block"),
    )
    # a block's rows in one file or, where they are many, in several: adaptive execution splits a hot block
    edges.hint("rebalance", F.col("target_block")).sortWithinPartitions("target_block", "target_index", "source_index").write.mode("overwrite").partitionBy("target_block").parquet(f"{out}/edges")
    made = spark.read.schema(_EDGES).parquet(f"{out}/edges")  # an empty table has no file to learn columns from

    inward = received.select(F.col("target_index").alias("neuron_index"), "in_edges")
    outward = pairs.groupBy(F.col("source_index").alias("neuron_index")).agg(F.count("*").alias("out_edges"))
    neurons = census.drop("spread").join(_side(inward), "neuron_index", "left").join(outward, "neuron_index", "left").fillna(0, ["in_edges", "out_edges"])
    neurons.hint("rebalance", F.col("superclass")).sortWithinPartitions("superclass", "neuron_index").write.mode("overwrite").partitionBy("superclass").parquet(f"{out}/neurons")

    storage.discard(placed, received, census)
    totals = made.agg(F.count("*").alias("edges"), F.sum("synapse_count").alias("contacts")).first()
    log.info("wrote edges: %d rows, %s contacts", totals.edges, totals.contacts)
    for r in spark.read.schema(neurons.schema).parquet(f"{out}/neurons").groupBy("superclass").count().orderBy("superclass").collect():
        log.info("wrote neurons of %s: %d rows", r.superclass, r["count"])
    for r in spark.read.schema(_REJECTED).parquet(f"{out}/rejected").groupBy("reason").agg(F.sum("rows").alias("rows")).collect():
        log.info("rejected %d connections: %s", r.rows, r.reason)
    return made


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.graph_dataset", description=__doc__.split("\n")[0])
    parser.add_argument("--input", required=True, help="folder of the raw tables")
    parser.add_argument("--output", required=True, help="folder of the dataset")
    parser.add_argument("--config", default=f"file://{CONFIG}")
    chosen = parser.parse_args(args)
    spark = start("graph-dataset")
    try:
        run(spark, chosen.input, chosen.output, config(spark, chosen.config, ("tables", "signs", "block")))
    finally:
        spark.stop()


def _registered(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    import json

    with open(CONFIG) as file:  # beside this module, on the driver
        settings = json.load(file)
    return run(spark, sf_dir, out, settings).withColumns({c: F.col(c).cast("long") for c in ("source_index", "target_index", "target_block")})


job1_graph_dataset = twice("job1", _registered)

if __name__ == "__main__":
    main()
