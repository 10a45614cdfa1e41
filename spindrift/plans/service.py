"""What a live panel asks of a dataset: summaries, maps, neighbourhoods, presets, pathways, replays, telemetry snapshots.

Answers are small DataFrames; a web layer needs no more than toJSON. Bounds are those of config.BOUNDS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators import graph
from spindrift.plans.config import BOUNDS, _indices
from spindrift.plans.dataset import Dataset


def status(data: Dataset, atlas: DataFrame) -> DataFrame:
    """One row: neurons, edges, neurons with a soma row, with a visible one (group below 3)."""
    joined = data.neurons.select("body_id").join(atlas, "body_id", "left")
    return joined.agg(F.count("*").alias("neurons"), F.count("atlas_row").alias("with_soma"), F.count_if(F.col("atlas_group") < 3).alias("visible")).crossJoin(data.edges.agg(F.count("*").alias("edges")))  # one row each


def map_indices(data: Dataset, atlas: DataFrame, indices: list[int]) -> DataFrame:
    """(position, neuron_index, body_id as text, atlas_row, reason) in the order asked for."""
    wanted = graph.take(data.neurons, list(_indices("indices", indices, BOUNDS["indices"], 1)))
    joined = wanted.join(atlas, "body_id", "left")
    shown = F.col("atlas_group") < 3
    reason = F.when(F.col("atlas_row").isNull(), "no soma").when(~shown, "hidden group")
    return joined.select("position", "neuron_index", F.col("body_id").cast("string").alias("body_id"), F.when(shown, F.col("atlas_row")).alias("atlas_row"), reason.alias("reason")).orderBy("position")


def neighborhood(data: Dataset, seeds: list[int], max_nodes: int = 128, max_edges: int = 512, min_count: int = 1) -> DataFrame:
    _indices("seeds", seeds, BOUNDS["seeds"], 1)
    if not 1 <= max_nodes <= BOUNDS["nodes"] or not 1 <= max_edges <= BOUNDS["edges"] or min_count < 1:
        raise ValueError("budgets out of bounds")
    return graph.neighborhood(data.edges, seeds, max_nodes, max_edges, min_count)


def preset(neurons: DataFrame, edges: DataFrame, sources: DataFrame, types: list[str], per_type: int = 200) -> DataFrame:
    """(type, rank, neuron_index, contacts, watch): per type the per_type direct targets of sources with most contacts; the first is watched."""
    wanted = neurons.where(F.col("type").isin(types)).select(F.col("neuron_index").alias("target_index"), "type")
    direct = edges.join(sources.select(F.col("neuron_index").alias("source_index")), "source_index", "left_semi").join(wanted, "target_index").groupBy("type", "target_index").agg(F.sum("synapse_count").alias("contacts"))
    order = Window.partitionBy("type").orderBy(F.desc("contacts"), "target_index")
    ranked = direct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_type)
    return ranked.select("type", "rank", F.col("target_index").alias("neuron_index"), "contacts", (F.col("rank") == 1).alias("watch"))


def pathway_catalog(layers: DataFrame, paths: DataFrame, most: int = 64, per_target: int = 12) -> DataFrame:
    """(target, length, relays, paths): at most most targets; measured fields are left to observations."""
    kept = paths.where(F.col("rank") <= per_target).groupBy("target").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "nodes", "contacts"))).alias("paths"))
    shape = layers.groupBy("target", "length").agg(F.count_if(F.col("layer").between(1, F.col("length") - 1)).alias("relays"))
    return shape.join(kept, "target", "left").orderBy("target").limit(most)


def snapshot(chunks: DataFrame, session: str = "session") -> DataFrame:
    """(session, chunks, simulated_s, wall_s, speed_ratio, total_spikes, last_spikes) from rows (session, chunk, simulated_s, wall_s, spikes)."""
    out = chunks.groupBy(session).agg(F.count("*").alias("chunks"), F.sum("simulated_s").alias("simulated_s"), F.sum("wall_s").alias("wall_s"), F.sum("spikes").alias("total_spikes"), F.max_by("spikes", "chunk").alias("last_spikes"))
    return out.withColumn("speed_ratio", F.try_divide(F.col("simulated_s"), F.col("wall_s")))


def watched(samples: DataFrame, selections: DataFrame) -> DataFrame:
    """samples (session, chunk, neuron_index, ...) of neurons on their session's watch list at the time.

    selections (session, from_chunk, neuron_index): a list holds from its chunk until the next list's.
    """
    ends = selections.select("session", "from_chunk").distinct().withColumn("until", F.lead("from_chunk").over(Window.partitionBy("session").orderBy("from_chunk")))
    lists = selections.join(ends, ["session", "from_chunk"])
    inside = (F.col("s.chunk") >= F.col("w.from_chunk")) & (F.col("w.until").isNull() | (F.col("s.chunk") < F.col("w.until")))
    return samples.alias("s").join(lists.alias("w"), (F.col("s.session") == F.col("w.session")) & (F.col("s.neuron_index") == F.col("w.neuron_index")) & inside).select("s.*")


def pointer_moves(commands: DataFrame, pixel_step: float) -> DataFrame:
    """commands with pixel_dx, pixel_dy: a dry run of a pointer; half pixels go to the even neighbour."""
    return commands.withColumns({"pixel_dx": F.bround(F.col("dx") * pixel_step).cast("long"), "pixel_dy": F.bround(F.col("dy") * pixel_step).cast("long")})
