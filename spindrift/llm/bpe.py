"""Byte-level BPE encoding and decoding (operator 10).

A text is split by the tokenizer's pattern. Each piece is merged with a segment tree over its byte
positions: a leaf holds the rank of the pair that starts there, an inner node the smallest rank below
it, the leftmost first. A merge takes the root's pair and updates three leaves (the pair, its left
neighbour, the swallowed right part), each in logarithmic time, so a piece of n bytes costs O(n log n)
however long it is. Results equal those of the tiktoken library.
"""

from __future__ import annotations

import base64
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import common

_NONE = 1 << 62  # above every key: ranks and positions have fewer than 62 bits together
_loaded: dict[tuple, "Codec"] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: base64 of the token's bytes, a space, the rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    if n < 2:
        return tuple(ranks[piece[i : i + 1]] for i in range(n))
    get = ranks.get
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    # a node's key: rank and position in one integer, so that the smaller key is the leftmost minimum
    shift = n.bit_length()
    none = _NONE
    tree = [none] * (2 * width + 1)  # one spare: the last byte starts no pair
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank << shift | i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    low = (1 << shift) - 1
    while (least := tree[1]) != none:
        i = least & low
        j = after[i]
        k = after[j]
        after[i] = k
        mine = theirs = none
        if k < n:
            before[k] = i
            rank = get(piece[i : after[k]])
            if rank is not None:
                mine = rank << shift | i
        left = before[i]
        if left >= 0:
            rank = get(piece[left:k])
            if rank is not None:
                theirs = rank << shift | left
        for node, key in ((width + i, mine), (width + j, none), (width + left, theirs)):
            if tree[node] == key or node < width:  # unchanged; or no left neighbour
                continue
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                if other < key:
                    key = other
                node >>= 1
                if tree[node] == key:
                    break
                tree[node] = key
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return tuple(out)


class Codec:
    """Encodes and decodes with one vocabulary. Memory: the ranks and a memo of at most 2 x memo pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 300_000):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.number = {rank: str(rank) for rank in ranks.values()}
        self.pieces = common.TwoGenerations(lambda piece: merge(piece.encode(), ranks), memo, 64)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def listed(self, ids) -> str:
        return ",".join(map(self.number.__getitem__, ids))


def _codec(shared, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    common.sole_memo("bpe", _loaded.clear)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(read_ranks(shared.value), pattern)
    return _loaded[key]


#: Columns that tokenize() can add.
OUTPUTS = {
    "n_tokens": T.StructField("n_tokens", T.LongType(), False),
    "ids": T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    "ids_text": T.StructField("ids_text", T.StringType(), False),
    "decoded": T.StructField("decoded", T.BinaryType(), False),
}


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with its texts' token ids, and what they decode to.

    outputs: n_tokens; ids (array of int); ids_text (ids in decimal, joined by commas); decoded (the bytes
    that the ids decode to). ranks_path is read on the driver and broadcast: a vocabulary file, about 1 MB,
    whatever the input's size. Narrow: no shuffle, one row in, one row out.

    Null text counts as empty: no ids, empty decoded bytes. Repeated rows stay. Columns of docs with an
    output's name are replaced. Very long texts and pieces work in O(n log n).
    """
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    key = f"{ranks_path}:{pattern}"

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(_Named(key, shared), pattern)
        ids = [codec.encode(t) if t else [] for t in common.texts_of(part, text)]
        made = {"n_tokens": lambda: pa.array([len(x) for x in ids], pa.int64()), "ids": lambda: pa.array(ids, pa.list_(pa.int32())), "ids_text": lambda: pa.array([codec.listed(x) for x in ids], pa.string()), "decoded": lambda: pa.array([codec.decode(x) for x in ids], pa.binary())}
        return [made[name]() for name in outputs]

    return common.add_columns(docs, [OUTPUTS[name] for name in outputs], compute, text, keep)


class _Named:
    """A broadcast under a name that is the same in each task."""

    def __init__(self, name: str, shared):
        self.id, self.shared = name, shared

    @property
    def value(self) -> bytes:
        return self.shared.value


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents; digests of the ids and of the decoded bytes. Null and empty texts have no
    ids, and the digests of nothing; repeated rows each have their row; long texts and pieces are worked whole."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_text", "decoded"), keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
