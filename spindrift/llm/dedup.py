"""MinHash near-duplicates (operator 4).

1. Each text becomes its set of hashed word shingles; one permutation splits the hash range into bins and
   keeps each bin's minimum; empty bins take the value of a filled bin that a fixed probe sequence names
   (optimal densification). Bands of bins give bucket keys. Equal sets fall together first.
2. A bucket of two or more different sets has one centre: the member that shares most buckets. Its members
   and the centre form star-shaped candidate edges; over all buckets a centre gathers a family.
3. A family is worked in chunks of bounded size, each with the centre's text. Whole sets are intersected:
   centre against all members, and then each member that is not linked with the centre against those that share
   one of its rarest shingles, as many as a link can't do without (an exact prefix filter), over chunk
   borders too. So no link inside a family is lost, texts that only share frequent shingles don't meet, and
   links leave as a spanning forest: fewer rows than members, never all pairs.
4. Components of the links; the smallest id names the class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import common
from spindrift.llm.components import components

#: Shingles that one chunk of a family may hold.
CHUNK = 1_000_000
#: Families of several chunks whose sizes may be broadcast, 3 MB.
MOST_BROADCAST = 100_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_words: common.TwoGenerations | None = None


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _forget() -> None:
    global _words
    _words = None


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's width-word shingles; A-Z count as a-z.

    Fewer words than width: the whole sequence is one shingle. No word: none.
    """
    global _words
    common.sole_memo("dedup", _forget)
    if _words is None:
        _words = common.TwoGenerations(xxhash.xxh3_64_intdigest, 300_000, 64)
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    made = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        made = _mixed(made * _PRIME + h[k : len(h) - width + 1 + k])
    return np.unique(made)


class Sketch:
    """One-permutation sketches with bands x rows bins, densified; band keys as int64."""

    def __init__(self, bands: int = 32, rows: int = 5):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = np.array([((1 << 64) * i + self.bins - 1) // self.bins for i in range(self.bins)], np.uint64)
        probe = _mixed(np.arange(4096, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(self.bins, dtype=np.uint64)[None, :] + _PRIME)
        self.probe = (probe % np.uint64(self.bins)).astype(np.int32)
        self.salt = _mixed(np.arange(bands, dtype=np.uint64) + np.uint64(77))

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Band keys of a sorted non-empty set."""
        at = np.searchsorted(hashes, self.edges)
        filled = np.diff(at, append=len(hashes)) > 0
        least = hashes[np.minimum(at, len(hashes) - 1)]
        empty = np.flatnonzero(~filled)
        for a, b in ((0, 8), (8, 64), (64, 512), (512, 4096)):
            if not len(empty):
                break
            hit = filled[self.probe[a:b, empty]]
            some = hit.any(0)
            first = hit.argmax(0)
            least[empty[some]] = least[self.probe[a + first[some], empty[some]]]
            empty = empty[~some]
        if len(empty):
            least[empty] = hashes[0]
        out = self.salt.copy()
        for row in least.reshape(self.bands, self.rows).T:
            out = _mixed(out * _PRIME + row)
        return out.view(np.int64)


def sketched(docs: DataFrame, width: int, sketch: Sketch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, s1, s2, bands): set size, 128-bit name of the set, band keys (null for an empty set)."""
    fields = [T.StructField("n_shingles", T.LongType(), False), T.StructField("s1", T.LongType(), False), T.StructField("s2", T.LongType(), False), T.StructField("bands", T.ArrayType(T.LongType(), False), True)]

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        n, names, bands = [], [], []
        for t in common.bytes_of(part, text):
            hashes = shingles(t, width)
            n.append(len(hashes))
            names.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            bands.append(sketch.keys(hashes) if len(hashes) else None)
        name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        return [pa.array(n, pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(bands, pa.list_(pa.int64()))]

    return common.add_columns(docs, fields, compute, text, [key])


class _Block:
    """Sets of one chunk side by side, none of them empty; finds the sets linked with one of them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        # shingles as numbers that rise with how many sets have them, so that a sorted set begins with its rarest
        frequency = np.bincount(flat)
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.argsort(frequency, kind="stable")] = np.arange(len(vocabulary))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = rank[flat]
        self.flat = flat[np.lexsort((flat, owner))]
        self.mask = np.zeros(len(vocabulary), np.int64)
        # linked sets share at least percent of the larger one, so at least one of as many of the rarest as may be missing and one
        prefix = self.sizes - -(-percent * self.sizes // 100) + 1
        rarest = np.arange(len(self.flat)) - self.starts[owner] < prefix[owner]
        order = np.argsort(self.flat[rarest], kind="stable")
        self.listed = owner[rarest][order]
        self.ends = np.searchsorted(self.flat[rarest][order], np.arange(len(vocabulary) + 1))
        self.prefix = prefix

    def _linked(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]
        sizes = self.sizes[others]
        begins = np.cumsum(sizes) - sizes
        self.mask[own] = 1
        both = np.add.reduceat(self.mask[self.flat[np.repeat(self.starts[others] - begins, sizes) + np.arange(sizes.sum())]], begins)
        self.mask[own] = 0
        return others[100 * both >= self.percent * (sizes + self.sizes[i] - both)]

    def links(self, i: int) -> np.ndarray:
        """The sets with 100 * intersection >= percent * union with set i, by looking at all."""
        return self._linked(i, np.arange(len(self.sizes)))

    def near(self, i: int) -> np.ndarray:
        """The same sets, by looking at those that share one of the rarest shingles."""
        rarest = self.flat[self.starts[i] : self.starts[i] + self.prefix[i]]
        others = np.unique(np.concatenate([self.listed[self.ends[r] : self.ends[r + 1]] for r in rarest.tolist()]))
        sizes = self.sizes[others]
        fit = 100 * np.minimum(sizes, self.sizes[i]) >= self.percent * np.maximum(sizes, self.sizes[i])
        return self._linked(i, others[fit])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


_LINKS = "center long, a long, b long, loose boolean"


def _within_chunk(width: int, percent: int):
    """Links inside one chunk: centre first, then whoever it doesn't reach. loose rows name members not connected with the centre here."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        center, ids = key[0].as_py(), table.column("member").to_pylist()
        sets = [shingles(t, width) for t in table.column("text").cast(pa.binary()).to_pylist()]
        block, forest, rows = _Block(sets, percent), _Forest(len(ids)), []

        def link(i: int, others: np.ndarray) -> None:
            for j in others.tolist():
                if forest.join(i, j) and ids[i] != ids[j]:
                    rows.append((ids[i], ids[j], False))

        hub = ids.index(center) if center in ids else None
        if hub is not None:
            link(hub, block.links(hub))
        for i in range(len(ids)):
            if hub is None or forest.find(i) != forest.find(hub):
                link(i, block.near(i))
        if table.column("chunks")[0].as_py() > 1:
            rows += [(ids[i], None, True) for i in range(len(ids)) if hub is None or forest.find(i) != forest.find(hub)]
        return pa.table({"center": pa.array([center] * len(rows), pa.int64()), "a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "loose": pa.array([r[2] for r in rows], pa.bool_())})

    return work


def _across_chunks(width: int, percent: int):
    """Links of loose members of other chunks with one chunk's members."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, loose = table.column("member").to_pylist(), table.column("loose").to_pylist()
        rows = []
        if any(loose) and not all(loose):
            block, forest = _Block([shingles(t, width) for t in table.column("text").cast(pa.binary()).to_pylist()], percent), _Forest(len(ids))
            for i in range(len(ids)):
                if loose[i]:
                    for j in block.near(i).tolist():
                        if not loose[j] and forest.join(i, j) and ids[i] != ids[j]:
                            rows.append((ids[i], ids[j]))
        return pa.table({"center": pa.array([key[0].as_py()] * len(rows), pa.int64()), "a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "loose": pa.array([False] * len(rows), pa.bool_())})

    return work


def _across(members: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """Families over several chunks: whoever its own chunk left loose meets the other chunks."""
    loose = found.where("loose").select("center", F.col("a").alias("member")).distinct().join(members.where("member <> center"), ["center", "member"])
    groups = loose.groupBy("center").agg(F.ceil(F.sum("n") / F.lit(CHUNK)).cast("int").alias("groups"))
    loose = loose.join(groups, "center").withColumn("group", F.pmod(F.xxhash64("member", F.lit(1)), F.col("groups")).cast("int"))
    loose = loose.withColumn("own", F.col("chunk")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunk <> own")
    inside = members.join(groups, "center").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    columns = ["center", "chunk", "group", "member", "text"]
    both = inside.select(*columns, F.lit(False).alias("loose")).unionByName(loose.select(*columns, F.lit(True).alias("loose")))
    return both.groupBy("center", "chunk", "group").applyInArrow(_across_chunks(width, percent), _LINKS)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs. Keys are whole numbers.

    Links: 100 * intersection >= percent * union of whole shingle sets, each confirmed on the sets.
    Candidates share a band; with the defaults two sets of similarity 0.8 do with probability 1 - 3e-6.
    component_id: the smallest key reachable; kept: it is the row's own key.

    Null or wordless text: n_shingles 0, linked with nothing. Null key: linked with nothing, component_id
    null, kept. Rows of one key are one document: linked by any of their texts. Ties go to the smaller key.
    Hot groups: equal sets are one class from a partial aggregate on; a family of near copies is cut in
    chunks of about CHUNK shingles by hash; buckets only ever meet in counts, maxima and joins.
    """
    drawn = common.materialize(sketched(docs.select(key, text), width, Sketch(bands, rows), key, text), "sketches").withColumnRenamed(key, "id")
    classes = common.materialize(drawn.where("n_shingles > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("member"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    # buckets of two or more classes
    spread = classes.select("member", "n", F.explode("bands").alias("bucket"))
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = common.materialize(spread.join(crowded, "bucket"), "buckets")
    # the centre of a bucket: its member with most company over all buckets
    company = shared.groupBy("member").agg(F.sum("size").alias("company"))
    center = shared.join(company, "member").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("member")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("center"))
    family = shared.join(center, "bucket").select("center", "member", "n").distinct()
    family = common.materialize(family, "families")
    common.discard(shared)
    # families of several chunks: at most a row for each CHUNK shingles of all families, sent to all tasks up to a bound
    chunks = family.groupBy("center").agg(F.sum("n").alias("n")).where(F.col("n") > CHUNK)
    chunks = common.materialize(chunks.select("center", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("several")), "chunks")
    large = chunks.count()
    placed = family.join(F.broadcast(chunks) if large <= MOST_BROADCAST else chunks, "center", "left").withColumn("chunks", F.coalesce("several", F.lit(1))).drop("several")
    # the centre stands in every chunk
    chunk = F.when(F.col("member") == F.col("center"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int")))
    placed = placed.withColumn("chunk", F.explode(chunk))

    texts = docs.select(F.col(key).alias("member"), F.col(text).alias("text")).where("text is not null")
    # by a shuffle of the texts at every size: a broadcast of the members would end at some size
    filled = placed.hint("merge").join(texts, "member").select("center", "chunk", "chunks", "member", "n", "text")
    if large:  # their texts are needed twice, and then lie in the shared folder
        filled = common.materialize(filled, "members")
    found = common.materialize(filled.select("center", "chunk", "chunks", "member", "text").groupBy("center", "chunk").applyInArrow(_within_chunk(width, percent), _LINKS), "links")
    links = found.where("not loose").select("a", "b")
    if large:
        links = links.unionByName(_across(filled.where("chunks > 1"), found, width, percent).select("a", "b"))

    roots = components(links)
    common.discard(family, chunks, filled, found)
    named = classes.select("s1", "s2", "member").join(roots, classes["member"] == roots["node"], "left").select("s1", "s2", F.coalesce("root", "member").alias("root"))
    out = drawn.select("id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.coalesce("root", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by 2-word shingles at similarity 0.8. Null and wordless texts link with nothing and are kept;
    repeated rows link with one another; ties go to the smaller id."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2)


def op4_sql() -> str:
    """The same in SQL: prefix filter over the rarest shingles, exact intersections, recursive reachability."""
    return r"""
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM cut)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), df AS (SELECT s, count(*) AS f FROM sh GROUP BY 1),
p AS (SELECT doc_id, s, n FROM (SELECT sh.doc_id, sh.s, n, row_number() OVER (PARTITION BY sh.doc_id ORDER BY f, sh.s) AS r FROM sh JOIN n ON n.doc_id = sh.doc_id JOIN df ON df.s = sh.s) WHERE r <= n - (8 * n + 9) // 10 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND x.s = y.s GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT x, b FROM reach JOIN e ON y = a),
root AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN root ON root.doc_id = d.doc_id
"""
