"""A graph as compressed blocks: sparse products without a row for an edge.

A row holds the edges between WIDTH targets and WIDTH sources, or a part of them: distinct targets, where each one's edges begin, sources
(2 bytes each) and counts (1, 2, 4 or 8 bytes each, as the largest needs), target-major. A product takes a row at a
time, gathers the drives of its sources and sums them by target, so that what is shuffled is a number for each target and row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from spindrift.operators import graph

#: Indices of a block's side (2 bytes); edges of a row, at most; bytes of drives that workers may be sent.
WIDTH, PART, MOST_DRIVES = 1 << 16, 1 << 18, 64 << 20
SCHEMA = "target_block int, source_block int, edges long, targets binary, starts binary, sources binary, counts binary"


def _small(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max())
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _pack(batches: Iterator[pa.RecordBatch], part: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of edges in the order of blocks, targets and sources; repeated pairs and negative counts raise."""
    held: list[np.ndarray] = []
    rows: list[tuple] = []

    def finish(edges: np.ndarray, whole: bool) -> np.ndarray:
        """Make rows of whole blocks, and of full parts; what is left of the last block."""
        if not edges.shape[1]:
            return edges
        block = np.flatnonzero((edges[:2, 1:] != edges[:2, :-1]).any(0)) + 1
        for a, b in zip([0, *block], [*block, edges.shape[1]], strict=True):
            while b - a >= part or b - a and (b < edges.shape[1] or whole):
                cut = min(a + part, b)
                tb, sb, target, source, count = edges[:, a:cut]
                new = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
                if (np.diff(target * WIDTH + source) <= 0).any() or count.min() < 0:
                    raise ValueError("edges must be distinct and counts not negative")
                rows.append((int(tb[0]), int(sb[0]), cut - a, target[new].astype(np.uint16).tobytes(), new.astype(np.uint32).tobytes(), source.astype(np.uint16).tobytes(), _small(count).tobytes()))
                a = cut
        return edges[:, a:]

    def told() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()

    rest = np.empty((5, 0), np.int64)
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        if sum(h.shape[1] for h in held) >= part:
            rest = finish(np.concatenate([rest, *held], 1), False)
            held = []
            yield from told()
    finish(np.concatenate([rest, *held], 1), True)
    yield from told()


def pack(edges: DataFrame, part: int = PART) -> DataFrame:
    """Blocks of edges (source_index, target_index, synapse_count), sorted by ranges: a hot target's edges go to several rows, of several tasks."""
    place = {"target_block": F.shiftright("target_index", 16).cast("int"), "source_block": F.shiftright("source_index", 16).cast("int"), "target": F.col("target_index").bitwiseAND(WIDTH - 1), "source": F.col("source_index").bitwiseAND(WIDTH - 1)}
    placed = edges.select(*[c.alias(n) for n, c in place.items()], "synapse_count")
    ordered = placed.repartitionByRange(*place).sortWithinPartitions(*place)
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    return ordered.mapInArrow(lambda batches: _pack(batches, part, schema), SCHEMA)


def write(edges: DataFrame, path: str, part: int = PART) -> None:
    """Written once; existing output raises."""
    pack(edges, part).write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    """(targets, starts, sources, counts), blocks' offsets added."""
    targets = np.frombuffer(row["targets"], np.uint16).astype(np.int64) + (row["target_block"] << 16)
    sources = np.frombuffer(row["sources"], np.uint16).astype(np.int64) + (row["source_block"] << 16)
    counts = np.frombuffer(row["counts"], f"u{len(row['counts']) // row['edges']}")
    return targets, np.frombuffer(row["starts"], np.uint32).astype(np.int64), sources, counts


def unpack(blocks: DataFrame) -> DataFrame:
    """The edges again."""
    schema = pa.schema([("source_index", pa.int64()), ("target_index", pa.int64()), ("synapse_count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                targets, starts, sources, counts = _arrays(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(sources), pa.array(np.repeat(targets, np.diff(starts, append=len(sources)))), pa.array(counts.astype(np.int64))], schema=schema)

    return blocks.mapInArrow(run, "source_index long, target_index long, synapse_count long")


def _products(blocks: DataFrame, drives: DataFrame, size: int) -> DataFrame:
    """(target_index, amount, visited): sums of count x drive, and how many edges had one, for each target and row. size: one more than the largest index."""
    known = drives.toArrow()  # at most MOST_DRIVES bytes
    vector = np.zeros(-(-size // WIDTH) * WIDTH)
    vector[known.column("source_index").to_numpy()] = known.column("drive").to_numpy()
    sent = blocks.sparkSession.sparkContext.broadcast(vector)
    schema = pa.schema([("target_index", pa.int64()), ("amount", pa.float64()), ("visited", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                targets, starts, sources, counts = _arrays(batch.slice(i, 1).to_pylist()[0])
                drive = x[sources]
                visited = np.add.reduceat((drive != 0).astype(np.int64), starts)
                amount = np.add.reduceat(counts * drive, starts)
                hit = visited > 0
                yield pa.RecordBatch.from_arrays([pa.array(targets[hit]), pa.array(amount[hit]), pa.array(visited[hit])], schema=schema)

    live = np.unique(known.column("source_index").to_numpy() // WIDTH).tolist() if known.num_rows else []
    return blocks.where(F.col("source_block").isin(live)).mapInArrow(run, "target_index long, amount double, visited long")


def accumulate(neurons: DataFrame, blocks: DataFrame, events: DataFrame) -> DataFrame:
    """(target_index, amount, visited) from events (source_index, activity): what graph.accumulate gives.

    A source's events count together. Where drives are over MOST_DRIVES bytes, blocks are unpacked and joined.
    """
    drives = graph.driven(neurons, events)
    size = (neurons.agg(F.max("neuron_index")).first()[0] or 0) + 1
    if size * 8 > MOST_DRIVES:
        return graph.accumulate(neurons, unpack(blocks), events)
    found = _products(blocks, drives.groupBy("source_index").agg(F.sum("drive").alias("drive")), size)
    return found.groupBy("target_index").agg(F.sum("amount").alias("amount"), F.sum("visited").alias("visited"))


def propagate(neurons: DataFrame, blocks: DataFrame, activity: DataFrame) -> DataFrame:
    """(neuron_index, output) for every neuron: what graph.propagate gives."""
    reached = accumulate(neurons, blocks, activity).select(F.col("target_index").alias("neuron_index"), F.col("amount").alias("output"))
    return neurons.select("neuron_index").join(reached, "neuron_index", "left").select("neuron_index", F.coalesce("output", F.lit(0.0)).alias("output"))
