"""Embedding near-duplicates (operator 9): collision counting over sorted one-dimensional projections.

Unit vectors are projected on many random lines. On a sorted line the vectors whose projections lie in the
window centred on a query's are a run of ranks; each is a collision of that pair. Pairs of the wanted
cosine or more collide on each line with a known probability, so the count of collisions that all but one
in 10,000 of them reach is known too; pairs that reach it are verified by cosine in double precision.

One line's windows alone would pair each vector with a fixed part of all vectors (a quarter at cosine 0.98).
So a line is sorted within the grid cells of some others: lines form groups, the last line of each is
sorted and its windows give the candidates among the vectors that share the cell of the group's other
lines. How many lines a group has follows the logarithm of the number of vectors, so that a vector's
candidates by chance don't grow with it; how many groups there are makes a pair at the wanted cosine
miss them all with probability below 0.001, at cosines above it sooner still.

Equal vectors are one class from a partial aggregate on. A sorted line is cut in stretches of four windows,
each with the first window of the next; crowded stretches are worked in pairs of chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import common
from spindrift.llm.components import components
from spindrift.llm.dedup import _Forest

#: Vectors in one chunk of a stretch; rows of stretches that are worked at once; pairs looked at together.
CHUNK, BATCH, PAIRS = 1024, 1024, 200_000


class Lines:
    """Random lines in groups, and the windows and the count calibrated for a cosine.

    vectors: how many there are of a label, at most. cell, reach, window: in spreads of the difference of two
    projections at the wanted cosine, the width of grid cells, and half the windows on sorted lines and
    for counting. unmet: how often a pair at the cosine may meet in no group; miss: how often its count may
    fall short. counted: lines that collisions are counted on, at most. A cosine that would need more than 2,000
    groups (0.88 and less at a million vectors) raises: random lines don't tell such pairs from chance.
    """

    def __init__(self, dimension: int, cosine: float, vectors: int, cell: float = 4.5, reach: float = 2.5, window: float = 1.5, unmet: float = 1e-3, miss: float = 1e-4, counted: int = 168, seed: int = 9):
        spread = math.sqrt(2 - 2 * cosine)
        self.cell, self.reach, self.window = cell * spread, np.float32(reach * spread), window * spread
        # vectors at right angles share a cell of one line so often
        chance = min(0.9, self.cell / math.sqrt(4 * math.pi))
        self.per_group = max(2, math.ceil(math.log(max(vectors, 2)) / -math.log(chance)))
        same_cell = 1 - math.sqrt(2 / math.pi) / cell
        meet = same_cell ** (self.per_group - 1) * math.erf(reach / math.sqrt(2))
        self.groups = max(1, math.ceil(math.log(unmet) / math.log1p(-meet)))
        if self.groups > 2_000:
            raise ValueError(f"cosine {cosine} is too low for {vectors} vectors of a label")
        n = self.groups * self.per_group
        random = np.random.default_rng([seed, dimension])
        self.lines = random.standard_normal((dimension, n))
        self.offset = random.random(n)
        self.counted = min(n, counted)
        p = math.erf(window / math.sqrt(2))
        # the largest count that a pair at the wanted cosine reaches with probability 1 - miss (binomial)
        below, self.count, n = 0.0, 0, self.counted
        for k in range(n + 1):
            below += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
            if below > miss:
                self.count = k
                break

    def places(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each vector and group: its cell, its projection on the sorted line, its stretch of that line, and the one before or -1.

        A cell is an int32 hash (equal cells, equal numbers), a stretch an int64 hash of cell and number. The stretch
        before is given where a window from there reaches the vector.
        """
        projected = (unit @ self.lines).reshape(len(unit), self.groups, self.per_group)
        at = np.floor(projected[:, :, :-1] / self.cell + self.offset.reshape(self.groups, self.per_group)[:, :-1]).astype(np.int64)
        out = np.zeros((len(unit), self.groups), np.uint64)
        for k in range(self.per_group - 1):
            out = _hashed(out, at[:, :, k])
        cells = (out >> np.uint64(32)).astype(np.uint32).view(np.int32)
        spots = projected[:, :, -1].astype(np.float32)
        wide = spots.astype(np.float64)
        own = np.floor(wide / (4 * self.reach)).astype(np.int64)
        before = np.floor((wide - 1.001 * self.reach) / (4 * self.reach)).astype(np.int64)
        place = lambda number: (_hashed(cells.astype(np.int64).view(np.uint64), number) >> np.uint64(1)).view(np.int64)
        return cells, spots, place(own), np.where(before < own, place(before), -1)

    def counts(self, projected: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of rows of projected, on how many counted lines b lies in the window centred on a."""
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 8192):
            gap = projected[a[i : i + 8192]]
            gap -= projected[b[i : i + 8192]]
            np.abs(gap, out=gap)
            out[i : i + 8192] = np.count_nonzero(gap <= self.window, axis=1)
        return out


def _hashed(state: np.ndarray, number: np.ndarray) -> np.ndarray:
    state = (state ^ number.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return state ^ (state >> np.uint64(29))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


_FIELDS = [T.StructField(n, t, True) for n, t in (("vector", T.BinaryType()), ("cells", T.BinaryType()), ("spots", T.BinaryType()), ("own", T.ArrayType(T.LongType())), ("before", T.ArrayType(T.LongType())), ("s1", T.LongType()), ("s2", T.LongType()))]


def prepared(rows: DataFrame, cosine: float, vectors: int, options: dict, embedding: str = "embedding") -> DataFrame:
    """rows with vector (doubles as bytes), its places, and a 128-bit name of the vector; all null where it links with nothing."""

    def run(batches):
        lines: dict[int, Lines] = {}
        for batch in batches:
            made = {f.name: [None] * batch.num_rows for f in _FIELDS}
            by_size: dict[int, list[int]] = {}
            values = batch.column(batch.schema.get_field_index(embedding)).to_pylist()
            for i, v in enumerate(values):
                if v is not None and batch.column(1)[i].as_py() is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v):
                    by_size.setdefault(len(v), []).append(i)
            for size, where in by_size.items():
                if size not in lines:
                    lines[size] = Lines(size, cosine, vectors, **options)
                full = np.array([values[i] for i in where], np.float64) + 0.0  # no negative zeros
                scale = np.abs(full).max(1)[:, None]
                for i, v, cells, spots, own, before in zip(where, full, *lines[size].places(_unit(full / scale)), strict=True):
                    raw = v.tobytes()
                    s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist()
                    for name, x in (("vector", raw), ("cells", cells.tobytes()), ("spots", spots.tobytes()), ("own", own), ("before", before), ("s1", s1), ("s2", s2)):
                        made[name][i] = x
            types = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(made.values(), types, strict=True))], names=["id", "label", *made])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], rows.schema["label"], *_FIELDS]))


def _windows(keys: np.ndarray, spots: np.ndarray, reach: float):
    """Blocks of row pairs (a, b): rows, sorted by key and spot, of one key and with b in the window that starts at a."""
    n = len(keys)
    start = np.arange(n)
    # keys far apart on one line: a window never reaches the next key
    line = keys * (4.0 * float(np.abs(spots).max(initial=0.0)) + 8.0 * reach) + spots
    many = np.searchsorted(line, line + 1.001 * reach, side="right") - start - 1
    ends = np.cumsum(many)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right")))
        k = many[first:last]
        a = np.repeat(start[first:last], k)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        first = last


def _links(cosine: float, vectors: int, options: dict):
    """Links in a batch of stretches, of pairs that met in no earlier group: counts per vector, and a spanning forest."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, copies, chunk, first, second, group, place = (np.array(table.column(c)).astype(np.int64) for c in ("id", "copies", "chunk", "first", "second", "group", "place"))
        raw = table.column("vector").to_pylist()
        guest = np.array(table.column("guest").combine_chunks())
        sizes = np.array([len(v) for v in raw])
        label = np.array(table.column("label").combine_chunks().dictionary_encode().indices)
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            lines = Lines(size // 8, cosine, vectors, **options)
            every = np.stack([np.frombuffer(c, np.float32) for c in table.column("spots").take(pa.array(own)).to_pylist()])
            spot = every[np.arange(len(own)), group[own]].astype(np.float64)
            keys = np.unique(np.stack([place[own], first[own], second[own], group[own], label[own]]), axis=1, return_inverse=True)[1].ravel()
            order = np.lexsort((ids[own], spot, keys))
            own, every, spot, keys = own[order], every[order], spot[order], keys[order]
            cells = np.stack([np.frombuffer(c, np.int32) for c in table.column("cells").take(pa.array(own)).to_pylist()])
            matrix = np.stack([np.frombuffer(raw[i], np.float64) for i in own])
            unit = _unit(matrix / np.abs(matrix).max(1)[:, None])
            projected = unit @ lines.lines[:, : lines.counted]
            for a, b in _windows(keys, spot, float(lines.reach)):
                # one of each chunk, one at home in the stretch, and no collision in the groups before
                p, q = own[a], own[b]
                right = ((chunk[p] == first[p]) & (chunk[q] == second[q]) | (chunk[q] == first[p]) & (chunk[p] == second[q])) & ~(guest[p] & guest[q])
                a, b = a[right], b[right]
                together = (cells[a] == cells[b]) & (np.abs(every[a] - every[b]) <= lines.reach)
                g = group[own[a]]
                fresh = together[np.arange(len(a)), g] & (together.argmax(1) == g)
                a, b = a[fresh], b[fresh]
                near = lines.counts(projected, a, b) >= lines.count
                a, b = a[near], b[near]
                close = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                found_a.append(own[a[close]])
                found_b.append(own[b[close]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        # a vector stands in several stretches of a batch: by its number from here on
        names, at = np.unique(ids, return_inverse=True)
        links = np.bincount(at[a], copies[b], len(names)) + np.bincount(at[b], copies[a], len(names))
        some = np.flatnonzero(links)
        forest, edges = _Forest(len(names)), []
        for x, y in zip(at[a].tolist(), at[b].tolist(), strict=True):
            if forest.join(x, y):
                edges.append((x, y))
        edge = names[np.array(edges, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(np.concatenate([names[some], edge[:, 0]])), "b": pa.array([None] * len(some) + edge[:, 1].tolist(), pa.int64()), "n": pa.array(np.concatenate([links[some], np.zeros(len(edge))]).astype(np.int64))})

    return work


def near_duplicates(rows: DataFrame, cosine: float = 0.98, key: str = "vec_id", embedding: str = "embedding", label: str = "label", **options) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of rows. Keys are whole numbers.

    Links: other vectors of an equal, non-null label with cosine >= cosine in double precision. Null or zero
    vectors, vectors with a null or non-finite component, null labels and null keys link with nothing and
    are kept; a null key has a null component_id. Vectors of different lengths don't link. Repeated rows are vectors of their
    own: copies of one another, counted in n_links. A key may name several vectors: each row has its own vector's links and
    class, and what two vectors of one key link with stays apart unless they link. Ties go to the smaller key. options: those of Lines.
    """
    base = rows.select(F.col(key).cast("long").alias("id"), F.when(F.col(key).isNotNull(), F.col(label)).alias("label"), F.col(embedding).alias(embedding))
    vectors = base.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    drawn = common.materialize(prepared(base, cosine, vectors, options, embedding), "vectors")
    known = ["vector", "cells", "spots", "own", "before"]
    classes = drawn.where("s1 is not null").groupBy("label", "s1", "s2").agg(F.min("id").alias("member"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in known])
    classes = common.materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # a number for each vector, as written; ids may repeat

    home = classes.select("label", "node", F.posexplode("own").alias("group", "place"), F.lit(False).alias("guest"))
    guests = classes.select("label", "node", F.posexplode("before").alias("group", "place"), F.lit(True).alias("guest")).where("place >= 0")
    spread = home.unionByName(guests)
    where = ["label", "group", "place"]
    crowded = spread.groupBy(*where).agg(F.count("*").alias("size"), F.bool_and("guest").alias("guests")).where("size > 1 and not guests").withColumn("chunks", F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")).drop("guests")
    crowded = common.materialize(crowded, "stretches")
    met = spread.join(crowded, where).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"first": F.least("chunk", "other"), "second": F.greatest("chunk", "other")})
    work = crowded.agg(F.sum(F.col("size") * F.col("chunks"))).first()[0] or 0
    met = met.withColumn("place", F.xxhash64(*where)).withColumn("batch", F.pmod(F.xxhash64("place", "first", "second"), F.lit(max(1, work // BATCH))).cast("int"))
    bodies = classes.select(F.col("node").alias("id"), "copies", "vector", "cells", "spots")
    filled = met.join(bodies, F.col("node") == F.col("id")).select("batch", "label", "place", "group", "guest", "first", "second", "chunk", "id", "copies", "vector", "cells", "spots")
    found = common.materialize(filled.groupBy("batch").applyInArrow(_links(cosine, vectors, options), "a long, b long, n long"), "links")
    common.discard(crowded)

    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    roots = roots.withColumnRenamed("node", "linked")
    named = classes.select("label", "s1", "s2", "node", "member", "copies").join(counts, F.col("node") == F.col("a"), "left").join(roots, F.col("node") == F.col("linked"), "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.where("linked is not null").groupBy(F.col("root").alias("of")).agg(F.min("member").alias("least"))  # vectors without links are their own
    named = named.join(least, F.col("root") == F.col("of"), "left")
    named = named.select("label", "s1", "s2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "member").alias("root"))
    out = drawn.select("id", "label", "s1", "s2").join(named, ["label", "s1", "s2"], "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at cosine 0.98 within a label. Null, zero or non-finite vectors and null labels link with
    nothing and are kept; repeated ids, rows and vectors, ties and empty tables are as near_duplicates() says."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op9_sql() -> str:
    """The same in SQL: every pair of a label, and recursive reachability."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT x, b FROM reach JOIN l ON y = a),
root AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN root ON root.vec_id = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id
"""
