"""Raw annotation, transmitter and connection tables to a validated, dense-indexed graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Annotation columns of a raw table and their names in the graph. Fixed values.
NEURON_COLUMNS = {
    "status": "status", "statusLabel": "status_label", "superclass": "superclass", "class": "class", "subclass": "subclass", "type": "type", "instance": "instance",
    "rootSide": "root_side", "somaSide": "soma_side", "somaNeuromere": "soma_neuromere", "entryNerve": "entry_nerve", "exitNerve": "exit_nerve", "receptorType": "receptor_type", "fruDsx": "fru_dsx",
}
NT_COLUMNS = {"consensus_nt": "consensus_nt", "predicted_nt": "predicted_nt", "predicted_nt_confidence": "predicted_nt_confidence", "ground_truth": "ground_truth_nt"}
#: Columns that each raw table must have; other columns are ignored. Fixed values.
REQUIRED = {
    "annotations": ["bodyId", *NEURON_COLUMNS],
    "neurotransmitters": ["body", *NT_COLUMNS],
    "connectivity": ["body_pre", "body_post", "weight"],
}
INT_MAX = 2**31 - 1


#: Rows of one range of keys, about, and how many ranges there are at most.
RANGE_ROWS, MOST_RANGES = 200_000, 1024


def key_ranges(df: DataFrame, key: str) -> tuple[int, Column]:
    """(rows, number of the range that key falls in): ranges of about equal numbers of rows, ascending, cut at quantiles.

    A row looks its range up in two steps of at most 32 comparisons each. Keys that many rows share lie in one range.
    """
    n, cuts = df.agg(F.count(key), F.percentile_approx(key, [i / MOST_RANGES for i in range(1, MOST_RANGES)], 10_000)).first()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    cuts = sorted({cuts[MOST_RANGES * i // ranges - 1] for i in range(1, ranges)}) if n else []
    if not cuts:
        return n, F.lit(0)
    coarse, fine = cuts[31::32], F.array(*[F.lit(c) for c in cuts])
    below = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col(key)))
    block = below(F.array(*[F.lit(c) for c in coarse])) if coarse else F.lit(0)
    return n, block * 32 + below(F.slice(fine, block * 32 + 1, F.lit(32)))


def range_offset(ranged: DataFrame, amount: Column) -> Column:
    """What lies before a row's __range: the sum of an aggregate over all earlier ranges, by a list of at most MOST_RANGES numbers.

    A join with these numbers would have the optimizer carry the range's definition over to their side, where the key isn't; such plans fail.
    """
    found = {r["__range"]: r["__n"] or 0 for r in ranged.groupBy("__range").agg(amount.alias("__n")).collect()}
    before = [0]
    for i in range(max(found, default=0)):
        before.append(before[-1] + found.get(i, 0))
    return F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("__range") + 1)


def dense_index(df: DataFrame, key: str, name: str = "neuron_index") -> DataFrame:
    """df with name: 0-based position of key in ascending order (keys unique, not null and integral); long beyond 2 ** 31 rows.

    Not one task's global sort: keys fall in ranges of about equal size, ranges are counted, and a row's position
    is its range's offset plus its place inside. Offsets are at most MOST_RANGES numbers.
    """
    n, number = key_ranges(df, key)
    ranged = df.withColumn("__range", number.cast("int"))
    inside = Window.partitionBy("__range").orderBy(key)
    place = (range_offset(ranged, F.count("*")) + F.row_number().over(inside) - 1).cast("int" if n <= INT_MAX else "long")
    return ranged.withColumn(name, place).drop("__range")


def check_columns(df: DataFrame, role: str) -> DataFrame:
    """Raises for missing columns or ids that aren't 64-bit; extra columns are let through."""
    missing = [c for c in REQUIRED[role] if c not in df.columns]
    if missing:
        raise ValueError(f"{role} lacks the columns {', '.join(missing)}")
    for c in REQUIRED[role]:
        if c in ("bodyId", "body", "body_pre", "body_post", "weight") and df.schema[c].dataType != T.LongType():
            raise TypeError(f"{role}.{c} must be a 64-bit integer, not {df.schema[c].dataType.simpleString()}")
    return df


def check_unique_ids(df: DataFrame, key: str) -> DataFrame:
    """(rows, null_ids, duplicate_ids) of a table; all but the first must be 0 in a valid one."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("null_ids"), (F.count(key) - F.count_distinct(key)).alias("duplicate_ids"))


def neuron_map(annotations: DataFrame, body: str = "bodyId", superclass: str = "superclass") -> DataFrame:
    """(body_id, neuron_index) of the census: bodies with a superclass."""
    return dense_index(annotations.where(F.col(superclass).isNotNull()).select(F.col(body).alias("body_id")), "body_id")


def neurons(annotations: DataFrame, transmitters: DataFrame) -> DataFrame:
    """The 20-column neuron table: the census with annotations and, where known, transmitters."""
    known = annotations.where(F.col("superclass").isNotNull()).select(F.col("bodyId").alias("body_id"), *[F.col(a).alias(b) for a, b in NEURON_COLUMNS.items()])
    nts = transmitters.select(F.col("body").alias("body_id"), *[F.col(a).alias(b) for a, b in NT_COLUMNS.items()])
    return dense_index(known, "body_id").join(nts, "body_id", "left").select("neuron_index", "body_id", *NEURON_COLUMNS.values(), *NT_COLUMNS.values())


def edges(connectivity: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_index, target_index, synapse_count): raw edges with both ends in the census.

    The map is joined on each end in turn; Spark broadcasts it where its size allows and shuffles otherwise.
    """
    source = mapping.select(F.col("body_id").alias("body_pre"), F.col("neuron_index").alias("source_index"))
    target = mapping.select(F.col("body_id").alias("body_post"), F.col("neuron_index").alias("target_index"))
    return connectivity.join(source, "body_pre").join(target, "body_post").select("source_index", "target_index", F.col("weight").alias("synapse_count"))


def edge_order_violations(table: DataFrame) -> DataFrame:
    """(duplicate_pairs, bad_weights): what a strict target-major order and positive 32-bit weights forbid."""
    pairs = table.groupBy("target_index", "source_index").agg(F.count("*").alias("n"), F.count_if(~F.col("synapse_count").between(1, INT_MAX)).alias("bad"))
    return pairs.agg(F.sum(F.col("n") - 1).cast("long").alias("duplicate_pairs"), F.sum("bad").cast("long").alias("bad_weights"))


def checked_edges(table: DataFrame) -> DataFrame:
    """Edges that raise while they're read if a weight is out of range."""
    ok = F.col("synapse_count").between(1, INT_MAX)
    return table.withColumn("synapse_count", F.when(ok, F.col("synapse_count")).otherwise(F.raise_error(F.lit("synapse_count out of range")).cast("long")))


def offsets(table: DataFrame, nodes: DataFrame, by: str = "target_index") -> DataFrame:
    """(node, degree, start): the compressed-row offsets of one orientation; every node has a row.

    The running sum goes over ranges of nodes first, then inside each range.
    """
    degree = nodes.select(F.col("neuron_index").alias("node")).join(table.groupBy(F.col(by).alias("node")).agg(F.count("*").alias("degree")), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    _, number = key_ranges(nodes.select(F.col("neuron_index").alias("node")), "node")
    ranged = degree.withColumn("__range", number.cast("int"))
    inside = Window.partitionBy("__range").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.select("node", "degree", (range_offset(ranged, F.sum("degree")) + F.coalesce(F.sum("degree").over(inside), F.lit(0))).cast("long").alias("start"))


def totals(table: DataFrame) -> DataFrame:
    """(edge_count, synaptic_contact_count, self_edge_count)."""
    return table.agg(F.count("*").alias("edge_count"), F.coalesce(F.sum("synapse_count"), F.lit(0)).cast("long").alias("synaptic_contact_count"), F.count_if(F.col("source_index") == F.col("target_index")).alias("self_edge_count"))


def string_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n): how often each non-null, non-empty value occurs."""
    return df.where(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def report(annotations: DataFrame, connectivity: DataFrame, neuron_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """One row: the counts that describe a normalized dataset."""
    parts = [
        neuron_table.agg(F.count("*").alias("neuron_count"), F.count_if(F.col("consensus_nt").isNull()).alias("neurons_without_consensus_nt")),
        totals(edge_table),
        annotations.agg(F.count_if(F.col("superclass").isNull()).alias("excluded_annotation_rows")),
        connectivity.agg(F.count("*").alias("__raw")),
    ]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return one.withColumn("excluded_connectivity_rows", F.col("__raw") - F.col("edge_count")).drop("__raw")


def orientation_check(incoming: DataFrame, outgoing: DataFrame) -> DataFrame:
    """One row on two written orientations of one graph: edges and contacts of each, edges that only one has or that differ
    in their count, and nodes whose out-degrees or sums of contacts differ."""
    pair = ["source_index", "target_index"]
    both = incoming.select(*pair, F.col("synapse_count").alias("a")).join(outgoing.select(*pair, F.col("synapse_count").alias("b")), pair, "full")
    per = both.groupBy("source_index").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.sum("a").alias("wa"), F.sum("b").alias("wb"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("apart"))
    return per.agg(
        F.sum("a").alias("in_edges"), F.sum("b").alias("out_edges"), F.sum("wa").alias("in_contacts"), F.sum("wb").alias("out_contacts"), F.sum("apart").alias("edges_apart"),
        F.count_if(~(F.col("a").eqNullSafe(F.col("b")) & F.col("wa").eqNullSafe(F.col("wb")))).alias("nodes_apart"),
    )


def content_lock(df: DataFrame) -> DataFrame:
    """(rows, content): a lock on content that doesn't depend on files or order: row count, and the sum of the rows' hashes.

    A row's hash is the first 60 bits of the md5 of its values as text, columns by name; null has a mark of its own.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    row: Column = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content"))
