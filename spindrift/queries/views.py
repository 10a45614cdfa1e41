"""Graph, spikes and features derived from the test tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators import graph, normalize

#: Transmitters that part sizes stand for, by p_size % 8. Fixed values.
NTS = {0: "acetylcholine", 1: "gaba", 2: "glutamate", 3: "dopamine", 4: "acetylcholine", 5: "serotonin", 6: "acetylcholine"}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def annotations(spark, d) -> DataFrame:
    """Parts as bodies; the PROMO type stands for a missing superclass."""
    p = read(spark, d, "part")
    side = F.when(F.col("p_partkey") % 2 == 0, "L").otherwise("R")
    made = {"bodyId": F.col("p_partkey"), "superclass": F.nullif("p_type", F.lit("PROMO")), "type": F.col("p_brand"), "rootSide": side, "instance": F.concat_ws("_", "p_brand", side), "status": F.lit("Traced")}
    return p.select(*[made.get(c, F.lit(None).cast("string")).alias(c) for c in normalize.REQUIRED["annotations"]])


def transmitters(spark, d) -> DataFrame:
    p = read(spark, d, "part").where(F.col("p_partkey") % 10 != 0)
    nt = F.try_element_at(F.create_map(*[F.lit(x) for k, v in NTS.items() for x in (k, v)]), F.col("p_size") % 8)
    return p.select(F.col("p_partkey").alias("body"), nt.alias("consensus_nt"), nt.alias("predicted_nt"), F.lit(None).cast("double").alias("predicted_nt_confidence"), F.when(F.col("p_size") % 11 == 0, "GABA").alias("ground_truth"))


def connectivity(spark, d) -> DataFrame:
    """Part to next part of an order, summed to pairs."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = read(spark, d, "lineitem").select(F.col("l_partkey").alias("body_pre"), F.lead("l_partkey").over(w).alias("body_post"))
    return steps.where("body_post is not null").groupBy("body_pre", "body_post").agg(F.count("*").alias("weight"))


def neurons(spark, d) -> DataFrame:
    return graph.with_sign(normalize.neurons(annotations(spark, d), transmitters(spark, d)))


def edges(spark, d) -> DataFrame:
    return normalize.edges(connectivity(spark, d), normalize.neuron_map(annotations(spark, d)))


def spikes(spark, d) -> DataFrame:
    """(event_id, neuron, population, time_d, value): time in days since 2024-01-01."""
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 86400e6
    return read(spark, d, "events").select("event_id", F.col("user_id").alias("neuron"), F.col("event_type").alias("population"), at.alias("time_d"), "value")


def contacts(spark, d) -> DataFrame:
    """(source, column, contacts): customers' orders by the nation of the supplier; a dense graph whose weights vary."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return li.join(o, "l_orderkey").join(s, "l_suppkey").groupBy(F.col("o_custkey").alias("source"), F.col("s_nationkey").cast("long").alias("column")).agg(F.count("*").alias("contacts"))


def trade(spark, d) -> DataFrame:
    """(source_index, target_index, synapse_count, sign): customer nation to supplier nation; odd nations inhibit."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("source_index"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("target_index"))
    counted = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").groupBy("source_index", "target_index").agg(F.count("*").alias("synapse_count"))
    return counted.withColumn("sign", F.when(F.col("source_index") % 2 == 1, -1).otherwise(1))


def frames(spark, d) -> DataFrame:
    """(frame, y, x, intensity): each event type's hours and days as an 8 x 6 picture of counts over the largest."""
    s = spikes(spark, d).select((F.floor("time_d") % 5).cast("int").alias("frame"), (F.floor(F.col("time_d") * 24) % 8).cast("int").alias("x"), (F.floor(F.col("time_d") * 96) % 6).cast("int").alias("y"))
    n = s.groupBy("frame", "y", "x").agg(F.count("*").alias("n"))
    return n.select("frame", "y", "x", (F.col("n") / F.max("n").over(Window.partitionBy())).alias("intensity"))  # 240 pixels


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as the oracle has them."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)) else F.col(f.name) for f in df.schema])


_NT_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in NTS.items())
#: Common table expressions of the same views.
SQL = {
    "ann": "ann AS (SELECT p_partkey AS body_id, nullif(p_type, 'PROMO') AS superclass, p_brand AS type, CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END AS side FROM part)",
    "nt": f"nt AS (SELECT p_partkey AS body_id, CASE p_size % 8 {_NT_CASES} END AS consensus_nt, CASE WHEN p_size % 11 = 0 THEN 'GABA' END AS ground_truth_nt FROM part WHERE p_partkey % 10 <> 0)",
    "neurons": "neurons AS (SELECT row_number() OVER (ORDER BY a.body_id) - 1 AS neuron_index, a.body_id, superclass, type, side, consensus_nt, ground_truth_nt, CASE lower(coalesce(ground_truth_nt, consensus_nt)) WHEN 'acetylcholine' THEN 1 WHEN 'gaba' THEN -1 WHEN 'glutamate' THEN -1 ELSE 0 END AS sign FROM ann a LEFT JOIN nt ON a.body_id = nt.body_id WHERE superclass IS NOT NULL)",
    "raw": "steps AS (SELECT l_partkey AS body_pre, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS body_post FROM lineitem), raw AS (SELECT body_pre, body_post, count(*) AS weight FROM steps WHERE body_post IS NOT NULL GROUP BY body_pre, body_post)",
    "edges": "edges AS (SELECT a.neuron_index AS source_index, b.neuron_index AS target_index, weight AS synapse_count FROM raw JOIN neurons a ON body_pre = a.body_id JOIN neurons b ON body_post = b.body_id)",
    "spikes": "spikes AS (SELECT event_id, user_id AS neuron, event_type AS population, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6::DOUBLE AS time_d, value FROM events)",
    "contacts": "contacts AS (SELECT o_custkey AS source, s_nationkey::BIGINT AS \"column\", count(*) AS contacts FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
    "trade": "trade AS (SELECT c_nationkey AS source_index, s_nationkey AS target_index, count(*) AS synapse_count, CASE WHEN c_nationkey % 2 = 1 THEN -1 ELSE 1 END AS sign FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey)",
    "frames": "pixels AS (SELECT (floor(time_d)::INT % 5) AS frame, (floor(time_d * 24)::INT % 8) AS x, (floor(time_d * 96)::INT % 6) AS y, count(*) AS n FROM spikes GROUP BY 1, 2, 3), frames AS (SELECT frame, y, x, n / max(n) OVER ()::DOUBLE AS intensity FROM pixels)",
}
_NEEDS = {"nt": ["ann"], "neurons": ["ann", "nt"], "edges": ["neurons", "raw"], "frames": ["spikes"]}


def with_(*names: str, recursive: bool = False) -> str:
    """WITH and the expressions of the views named and of those they need."""
    found: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in found:
            found.append(name)

    for name in names:
        add(name)
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(SQL[n] for n in found) + " "
