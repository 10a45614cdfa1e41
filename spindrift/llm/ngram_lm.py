"""LM scoring (operator 7): deleted interpolation of bigram, unigram and uniform estimates.

Counts of the whole training corpus are gathered without sending a row per occurrence:

1. Each task cuts its documents into blocks of about BLOCK bytes of text. A block's distinct unigrams and
   bigrams, as sorted 64-bit hashes with their counts, go to shards of the hash range: one row for each
   block and shard. An n-gram that a third of the corpus holds is one entry of a block like any other.
2. A shard adds up the counts and answers each block with totals in the order in which it asked: no
   hashes travel back, and most numbers are small, so answers compress to a fraction.
3. Blocks of the deleted fold meet their answers first: retained counts (without that fold) give each
   held-out bigram its estimates, tallied by context-frequency bucket in fine steps. Expectation-
   maximisation on the tally gives each bucket its mixture weights.
4. All blocks meet their answers and score their documents with full counts and these weights.

An n-gram is known by its hash: with n distinct ones, about n * n / 2 ** 65 pairs share their counts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from spindrift.llm import common

BLOCK = 4 << 20
#: Steps per octave, and the number of context-frequency buckets, of the tally that the weights are learned from.
STEPS, BUCKETS = 4, 48
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_SCHEMA = "block long, payload binary"
_RETURNS = "block long, held boolean, kind string, shard int, answer binary, kinds long, tokens long, retained long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Documents as token numbers. Token 0 starts a document and is no token of it, 1 ends it."""

    def __init__(self, texts: list[bytes], weights: np.ndarray):
        local: defaultdict[bytes, int] = defaultdict()
        local.default_factory = lambda: len(local) + 2
        parts, sizes = [], []
        for text in texts:
            words = text.lower().split()
            sizes.append(len(words) + 1)
            parts.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
            parts.append(np.ones(1, np.int64))
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.tokens = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        self.contexts[self.starts] = 0
        self.hashes = np.concatenate([np.array([_START, _END], np.uint64), np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))])
        width = len(self.hashes)
        pairs, self.pair_of = np.unique(self.contexts * width + self.tokens, return_inverse=True)
        counts = np.repeat(weights.astype(np.int64), self.sizes)  # 1 where the document is trained on
        self.pair_context, self.pair_token = pairs // width, pairs % width
        pair_hash = _mix(_mix(self.hashes[self.pair_context]) + self.hashes[self.pair_token])
        # what to ask for, in the order of hashes
        self.asked = {}
        for kind, hashes, n in (("u", self.hashes[1:], np.bincount(self.tokens, counts, width)[1:]), ("b", pair_hash, np.bincount(self.pair_of, counts, len(pairs)))):
            order = np.argsort(hashes, kind="stable")
            self.asked[kind] = (order, hashes[order], n[order].astype(np.int64))

    def answers(self, kind: str, answer: np.ndarray) -> np.ndarray:
        """Totals in the order of this block's tokens from 1 on (u) or pairs (b)."""
        out = np.empty_like(answer)
        out[..., self.asked[kind][0]] = answer
        return out


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ascending with the hash: the top 32 bits scaled."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    small = np.uint8 if not len(numbers) or numbers.max() < 256 else np.uint32 if numbers.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(small).itemsize]) + zlib.compress(numbers.astype(small).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def _packed_hashes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of as few bytes as the largest needs."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_hashes(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _blocks(batches, id_type: pa.DataType, most: int):
    """(number of the block, its id, held or not, texts, weights, ids): cut from one task's rows, the deleted fold apart."""
    waiting: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}

    def cut(held: bool):
        rows, waiting[held], size[held] = waiting[held], [], 0
        texts = [r[2] for r in rows]
        name = xxhash.xxh3_64()
        for r in rows:
            name.update(f"{r[0]}:{len(r[2])};".encode())
            name.update(r[2])
        return int.from_bytes(name.digest()[:7], "big"), held, texts, np.array([r[1] for r in rows], np.int64), pa.array([r[0] for r in rows], id_type)

    for batch in batches:
        for part in common.slices(batch, "text"):
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), common.bytes_of(part, "text"), part.column(2).to_pylist(), strict=True):
                held = row[3]
                waiting[held].append((row[0], row[1], row[2]))
                size[held] += len(row[2]) + 16
                if size[held] >= most:
                    yield cut(held)
    for held in (True, False):
        if waiting[held]:
            yield cut(held)


def _count(shards: int, id_type: pa.DataType, most: int):
    def run(batches):
        for name, held, texts, weights, _ in _blocks(batches, id_type, most):
            block = Block(texts, weights)
            rows = []
            for kind, (_, hashes, counts) in block.asked.items():
                ends = np.searchsorted(_shard(hashes, shards), np.arange(shards + 1))
                for s in range(shards):
                    a, b = ends[s], ends[s + 1]
                    if b > a:
                        rows.append((kind, s, name, held, _packed_hashes(hashes[a:b]), _packed(counts[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["kind", "shard", "block", "held", "hashes", "counts"])
        block = rows = None
        common.tidy()

    return run


def _add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A shard: totals for each row's hashes, retained and held-out, and the shard's own sums (block null)."""
    kind, shard = key[0].as_py(), key[1].as_py()
    held = table.column("held").to_pylist()
    lists = [_unpacked_hashes(h) for h in table.column("hashes").to_pylist()]
    counts = np.concatenate([_unpacked(c) for c in table.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(lists), return_inverse=True)
    from_held = np.repeat(np.array(held), [len(x) for x in lists])
    both = np.stack([np.bincount(at[~from_held], counts[~from_held], len(distinct)), np.bincount(at[from_held], counts[from_held], len(distinct))]).astype(np.int64)
    answers, done = [], 0
    for x in lists:
        mine = both[:, at[done : done + len(x)]]
        done += len(x)
        first = _packed(mine[0])
        answers.append(len(first).to_bytes(4, "big") + first + _packed(mine[1]))
    total = both.sum(0)
    n = len(lists)
    return pa.table({"block": pa.array([*table.column("block").to_pylist(), None], pa.int64()), "held": pa.array([*held, None], pa.bool_()), "kind": pa.array([kind] * (n + 1)), "shard": pa.array([shard] * (n + 1), pa.int32()), "answer": pa.array([*answers, None], pa.binary()), "kinds": pa.array([None] * n + [int((total > 0).sum())], pa.int64()), "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()), "retained": pa.array([None] * n + [int(both[0].sum())], pa.int64())})


def _payload(id_type: pa.DataType, only_held: bool, most: int):
    """One compressed row for each block: ids, weights and texts."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for name, held, texts, weights, ids in _blocks(batches, id_type, most):
            if held or not only_held:
                sink = pa.BufferOutputStream()
                batch = pa.RecordBatch.from_arrays([ids, pa.array(weights), pa.array(texts, pa.binary())], names=["id", "weight", "text"])
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])
        common.tidy()

    return run


def _opened(left: pa.Table, right: pa.Table):
    """For each block row: the block, its ids and weights, totals of tokens (from token 1 on) and pairs, each [retained, held-out]."""
    found: dict[str, list] = {"u": [], "b": []}
    for kind, shard, answer in zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True):
        cut = 4 + int.from_bytes(answer[:4], "big")
        found[kind].append((shard, np.stack([_unpacked(answer[4:cut]), _unpacked(answer[cut:])])))
    for payload in left.column("payload").to_pylist():
        with pa.ipc.open_stream(payload) as reader:
            rows = reader.read_all().combine_chunks()
        block = Block(rows.column("text").to_pylist(), np.array(rows.column("weight")))
        totals = {}
        for kind, parts in found.items():
            # blocks of equal content have one name, and each its own copy of the answers; the copies are equal
            parts = list(dict(parts).items())
            answer = np.concatenate([p for _, p in sorted(parts, key=lambda p: p[0])], axis=1) if parts else np.zeros((2, 0), np.int64)
            if answer.shape[1] != len(block.asked[kind][1]):
                raise RuntimeError("n-gram answers don't fit their block: the input gave other rows when it was read again; write it to a table first")
            totals[kind] = block.answers(kind, answer)
        yield block, rows.column("id"), totals["u"], totals["b"]


def _estimates(block: Block, u: np.ndarray, b: np.ndarray, tokens: int):
    """Per pair: bucket of the context's frequency, bigram and unigram maximum-likelihood estimates, from counts u and b."""
    frequency = np.concatenate([[u[0]], u])  # a start is seen as often as an end
    context = frequency[block.pair_context]
    return np.minimum(np.floor(np.log2(context + 1)).astype(np.int64), BUCKETS - 1), b / np.maximum(context, 1), frequency[block.pair_token] / max(tokens, 1)


def _steps(p: np.ndarray) -> np.ndarray:
    """Logarithmic steps of a probability; 1 for none."""
    return np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)


def _tally(tokens: int):
    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, _, u, b in _opened(left, right):
            bucket, p2, p1 = _estimates(block, u[0], b[0], tokens)
            n = np.bincount(block.pair_of, minlength=len(bucket))
            cells, at = np.unique(np.stack([bucket, _steps(p2), _steps(p1)]), axis=1, return_inverse=True)
            out.append((cells, np.bincount(at.ravel(), n)))
        cells = np.concatenate([c for c, _ in out], axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.table({"bucket": cells[0], "p2": cells[1], "p1": cells[2], "n": np.concatenate([n for _, n in out]).astype(np.int64) if out else np.zeros(0, np.int64)})

    return work


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights [bucket, (bigram, unigram, uniform)] by expectation-maximisation over (bucket, p2 steps, p1 steps, n)."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(cells):
        return weights
    bucket = cells[:, 0]
    estimate = np.stack([np.where(cells[:, k] <= 0, np.exp2(cells[:, k] / STEPS), 0.0) for k in (1, 2)] + [np.full(len(cells), uniform)], axis=1)
    for _ in range(rounds):
        part = weights[bucket] * estimate
        part *= (cells[:, 3] / part.sum(1))[:, None]
        sums = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], axis=1) + 0.1  # so that none is 0
        weights = sums / sums.sum(1, keepdims=True)
    return weights


def _score(id_type: pa.DataType, key_name: str, tokens: int, kinds: int, weights: np.ndarray):
    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for block, ids, u, b in _opened(left, right):
            bucket, p2, p1 = _estimates(block, u.sum(0), b.sum(0), tokens)
            w = weights[bucket]
            pair = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (kinds + 1))
            count = u.sum(0)[block.tokens - 1]
            base = np.log10((count + 1) / (tokens + 1 * (kinds + 1)))
            add = lambda x: np.add.reduceat(x, block.starts)  # noqa: B023, E731
            parts.append(pa.table({key_name: ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, "n_tokens": block.sizes, "n_known": add((count > 0).astype(np.int64)), "base_score": add(base), "score": add(pair[block.pair_of])}))
        block = ids = u = b = None
        common.tidy()
        schema = pa.schema([(key_name, id_type), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(parts).cast(schema) if parts else schema.empty_table()

    return work


def score(docs: DataFrame, train, deleted, key: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    train: boolean Column, which rows are learned from; deleted: which of those the mixture weights are
    learned on. Tokens: words with A-Z lower-cased, then one end. base_score: add-one unigram model; score:
    log10 probability by the interpolated model. Null text counts as empty: one end. Null keys and
    repeated rows are rows like others. No training rows: every estimate is the uniform one.

    block_bytes (BLOCK): text that a block holds, and that a shard of the hash range stands for. About (size of all texts
    / block_bytes) squared rows go to the shards, and a task needs some 30 times block_bytes of memory: give it
    what the executors allow, so that rows stay long on large inputs. Results don't depend on it.

    docs is read three times and must give the same rows in the same tasks each time, as tables do; if it
    doesn't, that is noticed and raised.
    """
    id_type = to_arrow_type(docs.schema[key].dataType)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(train, F.lit(False)).cast("int").alias("weight"), F.coalesce(train & deleted, F.lit(False)).alias("held"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = block_bytes or BLOCK
    shards = max(1, -(-size // most))

    asked = rows.mapInArrow(_count(shards, id_type, most), "kind string, shard int, block long, held boolean, hashes binary, counts binary")
    answered = common.materialize(asked.groupBy("kind", "shard").applyInArrow(_add_up, _RETURNS), "answers")
    sums = answered.where("block is null and kind = 'u'").agg(F.sum("kinds"), F.sum("tokens"), F.sum("retained")).first()
    kinds, tokens, retained = (int(x or 0) for x in sums)
    answers = answered.where("block is not null").select("block", "held", "kind", "shard", "answer")

    held = rows.mapInArrow(_payload(id_type, True, most), _SCHEMA)
    tally = held.groupBy("block").cogroup(answers.where("held").groupBy("block")).applyInArrow(_tally(retained), "bucket long, p2 long, p1 long, n long")
    cells = tally.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS x steps x steps
    weights = learn_weights(np.array([tuple(r) for r in cells], np.int64).reshape(-1, 4), 1 / (kinds + 1))

    fields = T.StructType([T.StructField(key, from_arrow_type(id_type), True), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = rows.mapInArrow(_payload(id_type, False, most), _SCHEMA).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(id_type, key, tokens, kinds, weights), fields)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; fold 2 of 7 is held out, fold 3 is the deleted one. Nulls, empty texts and repeated rows: as score() says."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = common.fold("doc_id", 7)
    return score(docs, fold != 2, fold == 3).select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
