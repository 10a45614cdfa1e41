"""Neurons chosen by what paths, types and assignments say of them, and what is counted of such sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import populations


def source_groups(assignments: DataFrame, statuses: list[str], visible: DataFrame) -> DataFrame:
    """(column, neuron_index): neurons of assignments (neuron_index, status, column) with an allowed status in a visible column."""
    kept = assignments.where(F.col("status").isin(statuses) & F.col("column").isNotNull())
    return kept.join(visible.select("column").distinct(), "column", "left_semi").select("column", "neuron_index")


def group_sizes(groups: DataFrame) -> DataFrame:
    """(column, members, first_member, last_member) of each group."""
    return groups.groupBy("column").agg(F.count("*").alias("members"), F.min("neuron_index").alias("first_member"), F.max("neuron_index").alias("last_member"))


def within_hops(distances: DataFrame, neurons: DataFrame, superclass: str, most: int) -> DataFrame:
    """(neuron_index, hop): neurons of a superclass at 1 to most hops."""
    near = distances.where(F.col("distance").between(1, most)).select(F.col("node").alias("neuron_index"), F.col("distance").alias("hop"))
    return near.join(neurons.where(F.col("superclass") == superclass), "neuron_index", "left_semi")


def relays(layers: DataFrame, neurons: DataFrame, superclasses: list[str], excluded_types: list[str]) -> DataFrame:
    """(neuron_index): interior nodes of paths (target, length, layer, node) of allowed superclasses, without the excluded types."""
    inside = layers.where((F.col("layer") >= 1) & (F.col("layer") < F.col("length"))).select(F.col("node").alias("neuron_index")).distinct()
    allowed = neurons.where(F.col("superclass").isin(superclasses) & ~F.coalesce(F.col("type").isin(excluded_types), F.lit(False)))
    return inside.join(allowed, "neuron_index", "left_semi")


def typed_layer(layers: DataFrame, neurons: DataFrame, targets: DataFrame, types: list[str], layer: int = 2) -> DataFrame:
    """(neuron_index): nodes of given types in a layer of the chosen targets' paths."""
    at = layers.where(F.col("layer") == layer).join(targets.select(F.col("neuron_index").alias("target")), "target", "left_semi")
    return at.select(F.col("node").alias("neuron_index")).distinct().join(neurons.where(F.col("type").isin(types)), "neuron_index", "left_semi")


#: What an intervention does to the relays that there are: takes some away, adds some, or both.
VARIANTS = {"baseline": (False, False), "remove": (True, False), "add": (False, True), "combined": (True, True)}


def variants(baseline: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(variant, neuron_index): the relays of each variant."""
    out = None
    for name, (take, give) in VARIANTS.items():
        some = populations.union(baseline.join(removed, "neuron_index", "left_anti") if take else baseline, *([added] if give else []))
        some = some.select(F.lit(name).alias("variant"), "neuron_index")
        out = some if out is None else out.unionByName(some)
    return out


def variant_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, targets, hop_passes, target_passes, mean_hop_error, mean_target_error) of results (hop_pass, target_pass, hop_error, target_error)."""
    return results.groupBy(*by).agg(F.count("*").alias("targets"), F.count_if("hop_pass").alias("hop_passes"), F.count_if("target_pass").alias("target_passes"), F.avg("hop_error").alias("mean_hop_error"), F.avg("target_error").alias("mean_target_error"))


def annotation_records(indices: DataFrame, neurons: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """(neuron_index, body_id, instance, type, superclass, hop): what is shown of neurons; hop is null without distances. Unknown indices raise."""
    found = indices.select("neuron_index").join(neurons.select("neuron_index", "body_id", "instance", "type", "superclass"), "neuron_index", "left")
    found = found.withColumn("body_id", F.when(F.col("body_id").isNotNull(), F.col("body_id")).otherwise(F.raise_error(F.lit("no such neuron")).cast("long")))
    if distances is None:
        return found.withColumn("hop", F.lit(None).cast("int"))
    return found.join(distances.select(F.col("node").alias("neuron_index"), F.col("distance").alias("hop")), "neuron_index", "left")


def anatomy(layers: DataFrame, sources: DataFrame, neurons: DataFrame, superclasses: list[str]) -> DataFrame:
    """One row: sources, reachable targets, watched nodes, first-hop nodes and relays of paths."""
    inside = F.col("layer").between(1, F.col("length") - 1)
    watch = layers.where("layer >= 1").select(F.col("node").alias("neuron_index")).distinct().join(sources, "neuron_index", "left_anti")
    kept = relays(layers, neurons, superclasses, [])
    counted = layers.agg(F.count_distinct("target").alias("targets"), F.count_distinct(F.when(F.col("layer") == 1, F.col("node"))).alias("first_hop"), F.count_distinct(F.when(inside, F.col("node"))).alias("interior"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(sources.select("neuron_index").distinct(), "sources").crossJoin(counted).crossJoin(one(watch, "watched")).crossJoin(one(kept, "relays"))  # one row each


def layer_counts(layers: DataFrame) -> DataFrame:
    """(layer, nodes): distinct nodes of each layer over all targets."""
    return layers.groupBy("layer").agg(F.count_distinct("node").alias("nodes"))


def official_by_index(official: DataFrame, neurons: DataFrame) -> DataFrame:
    """(column, neuron_index): official columns (column, body_id) with their neuron in the graph; columns without an id, or with an id that isn't there, are left out."""
    return official.where("body_id is not null").join(neurons.select("body_id", "neuron_index"), "body_id").select("column", "neuron_index")


def column_of_groups(groups: DataFrame, official: DataFrame, neurons: DataFrame) -> DataFrame:
    """(column, neuron_index) for each column that has a group; a column without an official id or whose neuron is missing raises while it's read."""
    wanted = groups.select("column").distinct().join(official.select("column", "body_id"), "column", "left").join(neurons.select("body_id", "neuron_index"), "body_id", "left")
    fail = F.when(F.col("body_id").isNull(), F.raise_error(F.concat(F.lit("no official neuron of "), "column"))).otherwise(F.raise_error(F.concat(F.lit("official neuron is not in the graph: "), F.col("column")))).cast("int")
    return wanted.select("column", F.when(F.col("neuron_index").isNotNull(), F.col("neuron_index")).otherwise(fail).alias("neuron_index"))


def column_contacts(edges: DataFrame, sources: DataFrame, official: DataFrame, typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, column, contacts) of sources' edges to official neurons (column, neuron_index), and (source, any_typed):
    whether a source reaches any neuron of the type at all (typed: neuron_index)."""
    mine = edges.join(sources.select(F.col("neuron_index").alias("source_index")), "source_index", "left_semi")
    contacts = mine.join(official.select("column", F.col("neuron_index").alias("target_index")), "target_index").groupBy(F.col("source_index").alias("source"), "column").agg(F.sum("synapse_count").alias("contacts"))
    flagged = mine.join(typed.select(F.col("neuron_index").alias("target_index"), F.lit(True).alias("hit")), "target_index", "left")
    reach = flagged.groupBy(F.col("source_index").alias("source")).agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("any_typed"))
    return contacts, sources.select(F.col("neuron_index").alias("source")).join(reach, "source", "left").withColumn("any_typed", F.coalesce("any_typed", F.lit(False)))


def mapping_counts(assignments: DataFrame, expected: int = 6) -> DataFrame:
    """One row on assignments (source, status, column, candidates): sources, assigned and their fraction, columns covered,
    those with just the expected number of sources and those with more."""
    occupied = assignments.where("column is not null").groupBy("column").agg(F.count("*").alias("n"))
    cover = occupied.agg(F.count("*").alias("covered"), F.count_if(F.col("n") == expected).alias("complete"), F.count_if(F.col("n") > expected).alias("above"))
    total = assignments.agg(F.count("*").alias("sources"), F.count("column").alias("assigned"), (F.count("column") / F.count("*")).alias("assigned_fraction"))
    return total.crossJoin(cover)  # one row each


def histogram(df: DataFrame, of: str, name: str) -> DataFrame:
    """(name, value, n): how many groups of df have each value."""
    return df.groupBy(F.lit(name).alias("name"), F.col(of).cast("long").alias("value")).agg(F.count("*").alias("n"))


def mapping_histograms(assignments: DataFrame) -> DataFrame:
    """(name, value, n): how many sources have so many candidates, and how many columns so many sources."""
    occupied = assignments.where("column is not null").groupBy("column").agg(F.count("*").alias("sources"))
    return histogram(assignments, "candidates", "candidates").unionByName(histogram(occupied, "sources", "occupancy"))


def checked_cartridges(resolved: DataFrame, official: DataFrame) -> DataFrame:
    """resolved (column, kind, source) where the official source (column, kind, source) is the same or not given; another one raises while it's read."""
    both = resolved.join(official.select("column", "kind", F.col("source").alias("__official")), ["column", "kind"], "left")
    good = F.col("__official").isNull() | (F.col("__official") == F.col("source"))
    return both.withColumn("source", F.when(good, F.col("source")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not the official source of"), "column", "kind")).cast("long"))).drop("__official")


def lamina_projections(cartridges: DataFrame, neurons: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, column, target_index, weight): signed contacts of each cartridge's source of each kind; sums of 0 drop out."""
    signed = cartridges.join(neurons.where("sign <> 0").select(F.col("neuron_index").alias("source"), "sign"), "source").select("kind", "column", F.col("source").alias("source_index"), "sign")
    return edges.join(signed, "source_index").groupBy("kind", "column", "target_index").agg(F.sum(F.col("synapse_count") * F.col("sign")).cast("long").alias("weight")).where("weight <> 0")


def source_signs(cartridges: DataFrame, neurons: DataFrame) -> DataFrame:
    """(kind, sources, lowest, highest): how many sources of each kind there are, and their signs' range."""
    signs = cartridges.join(neurons.select(F.col("neuron_index").alias("source"), "sign"), "source")
    return signs.groupBy("kind").agg(F.count_distinct("source").alias("sources"), F.min("sign").alias("lowest"), F.max("sign").alias("highest"))


def unexpected_signs(signs: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Kinds of source_signs() whose signs aren't all the expected one."""
    want = F.create_map(*[F.lit(x) for k, v in expected.items() for x in (k, v)])
    known = F.try_element_at(want, F.col("kind"))
    return signs.where(known.isNull() | (F.col("lowest") != known) | (F.col("highest") != known))


def motor_populations(neurons: DataFrame, specs: list[tuple[str, str, str | None]], superclass: str = "descending_neuron") -> DataFrame:
    """(key, rank, neuron_index, body_id): for specs (key, type, side or None) the neurons of a superclass, by body id. Repeated keys raise."""
    if len({k for k, _, _ in specs}) != len(specs):
        raise ValueError("population keys must differ")
    wanted = neurons.sparkSession.createDataFrame([(k, superclass, t, side, None) for k, t, side in specs], "key string, superclass string, type string, root_side string, sample_limit int")
    return populations.resolve(neurons, wanted, ["superclass", "type", "root_side"]).select("key", "rank", "neuron_index", "body_id")


def response_records(responses: DataFrame, axes: list[str], hop: str, drive: str, spikes: str) -> DataFrame:
    """Per target, axis and hop: members, largest drive and spikes; with the first silent, last driven and first spiking hop of the path."""
    per = responses.groupBy(*axes, hop).agg(F.count("*").alias("members"), F.max(F.abs(drive)).alias("max_drive"), F.sum(spikes).alias("spikes"))
    path = Window.partitionBy(*axes)
    return per.withColumns({
        "first_silent_hop": F.min(F.when(F.col("max_drive") == 0, F.col(hop))).over(path), "last_driven_hop": F.coalesce(F.max(F.when(F.col("max_drive") != 0, F.col(hop))).over(path), F.lit(0)),
        "first_spike_hop": F.min(F.when(F.col("spikes") > 0, F.col(hop))).over(path),
    })


def set_relations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: shared members of two sets, and members of the left that the right lacks. Disjoint: shared 0; a subset: missing 0."""
    both = left.select(key).distinct().join(right.select(key).distinct().withColumn("__r", F.lit(True)), key, "left")
    return both.agg(F.count("__r").alias("shared"), F.count_if(F.col("__r").isNull()).alias("missing"))


def require_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    if not left.select(key).join(right.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"the sets share values of {key}")


def require_subset(left: DataFrame, right: DataFrame, key: str) -> None:
    if not left.select(key).join(right.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"values of {key} are missing")


def diagnosis(members: DataFrame, neurons: DataFrame) -> DataFrame:
    """(fact, value, n): how many of a set's neurons have each transmitter, sign, side and instance; missing ones are called so."""
    mine = neurons.join(members.select("neuron_index").distinct(), "neuron_index", "left_semi")
    told = lambda name, c: F.struct(F.lit(name).alias("fact"), F.coalesce(c.cast("string"), F.lit("missing")).alias("value"))
    nt = F.lower(F.coalesce("ground_truth_nt", "consensus_nt"))
    facts = F.array(told("transmitter", nt), told("sign", F.col("sign")), told("side", F.col("root_side")), told("instance", F.col("instance")))
    return mine.select(F.explode(facts).alias("x")).groupBy("x.fact", "x.value").agg(F.count("*").alias("n"))
