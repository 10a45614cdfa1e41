"""Graph operators on a neuron table (neuron_index, body_id, annotations) and an edge table (source_index, target_index, synapse_count)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators import storage

#: Which way a transmitter drives its target. Fixed values; two policies differ in glutamate.
GLUTAMATE_INHIBITS = {"acetylcholine": 1, "gaba": -1, "glutamate": -1}
GLUTAMATE_EXCITES = {"acetylcholine": 1, "gaba": -1, "glutamate": 1}


def effective_transmitter() -> Column:
    """Ground truth if there is one, else the consensus."""
    return F.coalesce("ground_truth_nt", "consensus_nt")


def sign(transmitter: Column, policy: Mapping[str, int] = GLUTAMATE_INHIBITS, unknown: int = 0) -> Column:
    """-1, 0 or 1, whatever the case; null or unlisted: unknown."""
    if not set(policy.values()) | {unknown} <= {-1, 0, 1}:
        raise ValueError("signs are -1, 0 or 1")
    listed = F.create_map(*[F.lit(x) for k, v in policy.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(listed, F.lower(transmitter)), F.lit(unknown)).cast("tinyint")


def with_sign(neurons: DataFrame, policy: Mapping[str, int] = GLUTAMATE_INHIBITS, unknown: int = 0) -> DataFrame:
    return neurons.withColumn("sign", sign(effective_transmitter(), policy, unknown))


def select(neurons: DataFrame, **exact) -> DataFrame:
    """Indices of neurons whose annotations equal all given values, case-sensitively; null never matches."""
    for column in exact:
        if column not in neurons.columns:
            raise KeyError(column)
    return neurons.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in exact.items()], F.lit(True))).select("neuron_index")


def take(neurons: DataFrame, indices: list[int]) -> DataFrame:
    """(position, neuron_index, body_id) in the order asked for; an index out of range raises."""
    wanted = neurons.sparkSession.createDataFrame([(i, x) for i, x in enumerate(indices)], "position int, neuron_index int")
    found = wanted.join(neurons.select("neuron_index", "body_id"), "neuron_index", "left")
    return found.select("position", "neuron_index", F.when(F.col("body_id").isNotNull(), F.col("body_id")).otherwise(F.raise_error(F.lit("neuron index out of range")).cast("long")).alias("body_id"))


def incoming(edges: DataFrame, target: int) -> DataFrame:
    return edges.where(F.col("target_index") == target).select("source_index", "synapse_count")


def outgoing(edges: DataFrame, source: int) -> DataFrame:
    return edges.where(F.col("source_index") == source).select("target_index", "synapse_count")


def propagate(neurons: DataFrame, edges: DataFrame, activity: DataFrame) -> DataFrame:
    """(neuron_index, output) for every neuron: sums of count x sign x activity over its incoming edges.

    Signs go on the small activity side before it meets the edges, and silent sources never do.
    """
    reached = edges.join(driven(neurons, activity), "source_index").groupBy(F.col("target_index").alias("neuron_index")).agg(F.sum(F.col("synapse_count") * F.col("drive")).alias("output"))
    return neurons.select("neuron_index").join(reached, "neuron_index", "left").select("neuron_index", F.coalesce("output", F.lit(0.0)).alias("output"))


def driven(neurons: DataFrame, activity: DataFrame) -> DataFrame:
    """(source_index, drive) of sources with a sign and an amplitude."""
    return activity.join(neurons.select(F.col("neuron_index").alias("source_index"), "sign"), "source_index").withColumn("drive", F.col("activity") * F.col("sign")).where("drive <> 0").select("source_index", "drive")


def accumulate(neurons: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """(target_index, amount, visited) from events (source_index, activity): only what events reach."""
    return edges.join(driven(neurons, events), "source_index").groupBy("target_index").agg(F.sum(F.col("synapse_count") * F.col("drive")).alias("amount"), F.count("*").alias("visited"))


def project(neurons: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(target_index, weight, edge_count): signed contacts from a source set; sums of 0 drop out after counting.

    edge_count counts edges of sources with a sign, before any cancel.
    """
    signed = sources.select("source_index").distinct().join(neurons.select(F.col("neuron_index").alias("source_index"), "sign"), "source_index").where("sign <> 0")
    return edges.join(signed, "source_index").groupBy("target_index").agg(F.sum(F.col("synapse_count") * F.col("sign")).cast("long").alias("weight"), F.count("*").alias("edge_count")).where("weight <> 0")


def combine_duplicates(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Edges summed per pair; pairs that sum to 0 go."""
    return edges.groupBy("source_index", "target_index").agg(F.sum(weight).alias(weight)).where(F.col(weight) != 0)


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(local_source, local_target, synapse_count, source_index, target_index): edges inside a node set, renumbered by rank of index."""
    from spindrift.operators.normalize import dense_index

    local = dense_index(members.select("neuron_index").distinct(), "neuron_index", "local")
    a = local.select(F.col("neuron_index").alias("source_index"), F.col("local").alias("local_source"))
    b = local.select(F.col("neuron_index").alias("target_index"), F.col("local").alias("local_target"))
    return edges.join(a, "source_index").join(b, "target_index").select("local_source", "local_target", "synapse_count", "source_index", "target_index")


def carrying(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_index, target_index) of edges whose source has a sign: what searches walk on, written once for all of their hops."""
    carriers = neurons.where("sign <> 0").select(F.col("neuron_index").alias("source_index"))
    return storage.materialize(edges.join(carriers, "source_index", "left_semi").select("source_index", "target_index"), "carrying")


def _search(start: DataFrame, walk: DataFrame, hops: int) -> DataFrame:
    """start (keys and node) with distance 0, and what walk (node, next) reaches from it within hops.

    A hop joins the last frontier with the edges and leaves out what is known. Only the new frontier is written, to
    the shared folder, so plans stay one hop deep; what is known is the union of the frontiers.
    """
    keys = start.columns
    frontier = storage.materialize(start.withColumn("distance", F.lit(0)), "hop")
    found = frontier
    for hop in range(1, hops + 1):
        ahead = frontier.drop("distance").join(walk, "node").drop("node").withColumnRenamed("next", "node").select(*keys).distinct()
        frontier = storage.materialize(ahead.join(found.select(*keys), keys, "left_anti").withColumn("distance", F.lit(hop)), "hop")
        found = found.unionByName(frontier)
    return found


def distances(neurons: DataFrame, edges: DataFrame, sources: DataFrame, hops: int, forward: bool = True, walk: DataFrame | None = None) -> DataFrame:
    """(node, distance): bounded breadth-first search. A neuron without sign is reached but doesn't pass on.

    forward: from the sources along edges; else against them, where the presynaptic neuron must have a sign.
    walk: carrying(neurons, edges), where it is written already.
    """
    walk = carrying(neurons, edges) if walk is None else walk
    at, to = ("source_index", "target_index") if forward else ("target_index", "source_index")
    return _search(sources.select(F.col("neuron_index").alias("node")).distinct(), walk.select(F.col(at).alias("node"), F.col(to).alias("next")), hops)


def batched_reverse(neurons: DataFrame, edges: DataFrame, targets: DataFrame, hops: int, walk: DataFrame | None = None) -> DataFrame:
    """(target, node, distance): reverse search from every target at once."""
    walk = carrying(neurons, edges) if walk is None else walk
    start = targets.select(F.col("neuron_index").alias("target"), F.col("neuron_index").alias("node")).distinct()
    return _search(start, walk.select(F.col("target_index").alias("node"), F.col("source_index").alias("next")), hops)


def reverse_bits(neurons: DataFrame, edges: DataFrame, targets: DataFrame, hops: int, walk: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bits, slots): batched_reverse with 64 targets to a number.

    bits: node, block, bits, distance; bit k of a row is set where the target of slot 64 * block + k is that many hops from node. slots: target,
    block, bit. A hop joins the frontier with the edges, takes the union of the bits that meet and leaves out those that are
    known, so a frontier has at most a row for each node and 64 targets.
    """
    from spindrift.operators.normalize import dense_index

    walk = carrying(neurons, edges) if walk is None else walk
    slot = dense_index(targets.select(F.col("neuron_index").alias("target")).distinct(), "target", "slot")
    slots = storage.materialize(slot.select("target", F.floor(F.col("slot") / 64).cast("int").alias("block"), (F.col("slot") % 64).cast("int").alias("bit")), "slots")
    frontier = slots.select(F.col("target").alias("node"), "block", F.expr("shiftleft(1L, bit)").alias("bits"), F.lit(0).alias("distance"))
    found = frontier = storage.materialize(frontier, "hop")
    steps = walk.select(F.col("target_index").alias("node"), F.col("source_index").alias("next"))
    for hop in range(1, hops + 1):
        ahead = frontier.join(steps, "node").groupBy(F.col("next").alias("node"), "block").agg(F.bit_or("bits").alias("ahead"))
        known = found.groupBy("node", "block").agg(F.bit_or("bits").alias("known"))
        fresh = F.col("ahead").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        new = ahead.join(known, ["node", "block"], "left").select("node", "block", fresh.alias("bits"), F.lit(hop).alias("distance")).where("bits <> 0")
        frontier = storage.materialize(new, "hop")
        found = found.unionByName(frontier)
    return found, slots


def expanded(bits: DataFrame, slots: DataFrame) -> DataFrame:
    """A row for each target of each row of reverse_bits(): its other columns and target."""
    rows = bits.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", F.col("bits"), k) == 1))).drop("bits")
    return rows.join(slots, ["block", "bit"]).drop("block", "bit")


def path_layers(neurons: DataFrame, edges: DataFrame, sources: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """(target, length, layer, node): nodes on shortest effective paths from the sources to each target within hops. A written table."""
    walk = carrying(neurons, edges)
    ahead = distances(neurons, edges, sources, hops, walk=walk)
    bits, slots = reverse_bits(neurons, edges, targets, hops, walk=walk)
    back = expanded(bits.join(ahead.select("node"), "node", "left_semi"), slots)  # what the sources don't reach is on no path
    length = ahead.join(targets.select(F.col("neuron_index").alias("node")).distinct(), "node").select(F.col("node").alias("target"), F.col("distance").alias("length"))
    found = ahead.withColumnRenamed("distance", "layer").join(back, "node").join(length, "target").where(F.col("layer") + F.col("distance") == F.col("length")).select("target", "length", "layer", "node")
    return storage.materialize(found, "layers")


def layer_edges(neurons: DataFrame, edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(target, hop, source_index, target_index, synapse_count, sign): edges from each layer into the next."""
    a = layers.select("target", F.col("layer").alias("hop"), F.col("node").alias("source_index"))
    b = layers.select("target", (F.col("layer") - 1).alias("hop"), F.col("node").alias("target_index"))
    signs = neurons.where("sign <> 0").select(F.col("neuron_index").alias("source_index"), "sign")
    return edges.join(a, "source_index").join(b, ["target", "hop", "target_index"]).join(signs, "source_index").select("target", "hop", "source_index", "target_index", "synapse_count", "sign")


def ranked_paths(layers: DataFrame, between: DataFrame, limit: int, hops: int) -> DataFrame:
    """(target, rank, score, nodes, contacts): the limit best shortest paths of each target by summed log1p of contacts.

    Layer by layer each node keeps its limit best; of equal scores the larger node list, then the larger
    contact list wins.
    """
    best = layers.where("layer = 0").select("target", "node", F.lit(0.0).alias("score"), F.array("node").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("contacts"))
    order = Window.partitionBy("target", "node").orderBy(F.desc("score"), F.desc("nodes"), F.desc("contacts"))
    done = []
    for hop in range(hops + 1):
        at_end = best.where("node = target")
        done.append(at_end)
        if hop == hops:
            break
        step = between.where(F.col("hop") == hop).select("target", F.col("source_index").alias("node"), F.col("target_index").alias("next"), F.col("synapse_count").cast("long").alias("synapse_count"))
        grown = best.join(step, ["target", "node"]).select("target", F.col("next").alias("node"), (F.col("score") + F.log1p("synapse_count")).alias("score"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("contacts", F.array("synapse_count")).alias("contacts"))
        best = storage.materialize(grown.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= limit).drop("__rank"), "paths")
    whole = reduce(DataFrame.unionByName, done)
    rank = Window.partitionBy("target").orderBy(F.desc("score"), F.desc("nodes"), F.desc("contacts"))
    return whole.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit).select("target", "rank", "score", "nodes", "contacts")


def upstream_hop(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = 8) -> int | None:
    """Hops against the edges, whatever their signs, until any source is met; hop 0 doesn't count."""
    seen = frontier = targets.select("neuron_index").distinct()
    for hop in range(1, most + 1):
        before = edges.join(frontier.withColumnRenamed("neuron_index", "target_index"), "target_index", "left_semi").select(F.col("source_index").alias("neuron_index")).distinct()
        frontier = storage.materialize(before.join(seen, "neuron_index", "left_anti"), "frontier")
        if not frontier.join(sources, "neuron_index", "left_semi").isEmpty():
            return hop
        if frontier.isEmpty():
            return None
        seen = storage.materialize(seen.unionByName(frontier), "seen")
    return None


def strongest_edges(edges: DataFrame, limit: int) -> DataFrame:
    """The limit heaviest edges; ties by source, then target."""
    return edges.orderBy(F.desc("synapse_count"), "source_index", "target_index").limit(limit)


def strong_neighborhoods(edges: DataFrame, excitatory: DataFrame, seeds: int, size: int, candidates: int = 4096) -> DataFrame:
    """(seed, rank, member): for each of the first seeds distinct sources of the strongest excitatory edges, itself and its size - 1 strongest other targets."""
    usable = edges.where("source_index <> target_index").join(excitatory.select(F.col("neuron_index").alias("source_index")), "source_index", "left_semi")
    strong = strongest_edges(usable, candidates)
    first = Window.orderBy(F.desc("synapse_count"), "source_index")  # of at most candidates rows
    chosen = strong.groupBy("source_index").agg(F.max("synapse_count").alias("synapse_count")).withColumn("at", F.row_number().over(first)).where(F.col("at") <= seeds).select(F.col("source_index").alias("seed"))
    by_weight = Window.partitionBy("seed").orderBy(F.desc("synapse_count"), "target_index")
    near = edges.join(chosen, edges["source_index"] == chosen["seed"]).where("target_index <> seed").withColumn("rank", F.row_number().over(by_weight)).where(F.col("rank") < size)
    return chosen.select("seed", F.lit(0).alias("rank"), F.col("seed").alias("member")).unionByName(near.select("seed", "rank", F.col("target_index").alias("member")))


def neighborhood_candidates(edges: DataFrame, seeds: DataFrame, max_edges: int, min_count: int = 1) -> DataFrame:
    """(source_index, target_index, synapse_count, rank): each seed's heaviest edges, at most max_edges of each."""
    order = Window.partitionBy("source_index").orderBy(F.desc("synapse_count"), "target_index")
    return edges.where(F.col("synapse_count") >= min_count).join(seeds.select(F.col("neuron_index").alias("source_index")), "source_index", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_edges)


def neighborhood(edges: DataFrame, seeds: list[int], max_nodes: int = 256, max_edges: int = 2048, min_count: int = 1) -> DataFrame:
    """(source_index, target_index, synapse_count): a greedy selection of edges within budgets of nodes and edges.

    Candidates by weight, source, target; an edge that would bring too many nodes is skipped, not the last.
    At most len(seeds) x max_edges rows, bounded by the budgets, meet in the one greedy task.
    """
    if not 0 < len(seeds) <= 64 or len(set(seeds)) < len(seeds) or max_nodes < len(seeds):
        raise ValueError("1 to 64 different seeds, and room for them")
    import pandas as pd

    spark = edges.sparkSession
    wanted = spark.createDataFrame([(s,) for s in seeds], "neuron_index int")
    found = neighborhood_candidates(edges, wanted, max_edges, min_count).select("source_index", "target_index", "synapse_count")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, keep = set(seeds), []
        for row in pdf.sort_values(["synapse_count", "source_index", "target_index"], ascending=[False, True, True]).itertuples(index=False):
            more = {row.source_index, row.target_index} - nodes
            if len(nodes) + len(more) <= max_nodes:
                nodes |= more
                keep.append(row)
                if len(keep) == max_edges:
                    break
        return pd.DataFrame(keep, columns=pdf.columns).astype(pdf.dtypes.to_dict()) if keep else pdf.iloc[:0]

    return found.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: greedy(pdf[["source_index", "target_index", "synapse_count"]]), found.schema)


def group_sources(spark: SparkSession, indices: list[int]) -> DataFrame:
    """Index lists as a table; they must be unique and not negative."""
    if len(set(indices)) != len(indices) or any(i < 0 for i in indices):
        raise ValueError("indices must be unique and not negative")
    return spark.createDataFrame([(i,) for i in indices], "source_index int")


def truncated_layers(between: DataFrame, most: int = 50) -> DataFrame:
    """(target, hop, rank, ...): the heaviest edges of each hop of each target's paths, at most most; ties by source, then target."""
    order = Window.partitionBy("target", "hop").orderBy(F.desc("synapse_count"), "source_index", "target_index")
    return between.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
