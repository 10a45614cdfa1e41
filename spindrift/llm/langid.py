"""Language ID (operator 1): prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes with symbol counts. A text is coded word by
word: a space, the word's letters in UTF-8, a closing space; a context never reaches back over the opening
space. A symbol costs -log2 of its probability in the longest context seen in training; a symbol that
is new there costs an escape (method C: weight = number of different symbols) and is coded in the next
shorter context, with the symbols of the longer one excluded; below order 0 all bytes left are alike. The
statistics are frozen after training, so the code lengths are exact sums over words, and a word's cost
per language can be remembered. The language with the shortest code wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import common

ORDER = 4
UNKNOWN = "und"
_words = re.compile(r"[^\W\d_]+").findall
_live: dict[str, "Scorer"] = {}


def letters(text: str) -> list[str]:
    """Lower-cased runs of word characters that aren't digits."""
    return _words(text.lower())


def _coded(word: str) -> bytes:
    """The bytes of a word between spaces; only letters count."""
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    return b" " + word.encode() + b" " if word else b""


class ContextTree:
    """One language's contexts as sorted arrays, by order: nodes (context) and edges (context and symbol)."""

    def __init__(self, words: dict[str, int], order: int = ORDER):
        counts: list[dict[bytes, dict[int, int]]] = [defaultdict(dict) for _ in range(order + 1)]
        for word, n in words.items():
            code = _coded(word)
            for at in range(1, len(code)):
                symbol = code[at]
                for k in range(min(order, at) + 1):
                    seen = counts[k][code[at - k : at]]
                    seen[symbol] = seen.get(symbol, 0) + n
        self.order = order
        self.nodes, self.base, self.escape, self.base_x, self.escape_x, self.edges, self.bits = [], [], [], [], [], [], []
        for k in range(order + 1):
            rows, edges = [], []
            for context, seen in counts[k].items():
                total, kinds = sum(seen.values()), len(seen)
                base = math.log2(total + kinds)
                # what follows an escape from here: the shorter context without the symbols seen here
                base_x = escape_x = 0.0
                if k:
                    shorter = counts[k - 1][context[1:]]
                    rest, new = sum(shorter.values()) - sum(shorter[s] for s in seen), len(shorter) - kinds
                    if new:
                        base_x = math.log2(rest + new)
                        escape_x = base_x - math.log2(new)
                number = int.from_bytes(context, "big")
                rows.append((number, base, base - math.log2(kinds), base_x, escape_x))
                edges += [(number << 8 | s, math.log2(n)) for s, n in seen.items()]
            rows.sort(), edges.sort()
            self.nodes.append(np.array([r[0] for r in rows], np.int64))
            for into, i in ((self.base, 1), (self.escape, 2), (self.base_x, 3), (self.escape_x, 4)):
                into.append(np.array([r[i] for r in rows]))
            self.edges.append(np.array([e[0] for e in edges], np.int64))
            self.bits.append(np.array([e[1] for e in edges]))
        self.last = math.log2(max(1, 256 - len(counts[0].get(b"", ()))))

    def cost(self, grams: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """Bits of each symbol. grams[k]: its last k context bytes and itself as a number; depth: context bytes it has."""
        n = len(depth)
        cost, open_, started = np.zeros(n), np.ones(n, bool), np.zeros(n, bool)
        base_x, escape_x = np.zeros(n), np.zeros(n)
        for k in range(self.order, -1, -1):
            nodes, edges = self.nodes[k], self.edges[k]
            if not len(nodes):
                continue
            todo = np.flatnonzero(open_ & (depth >= k))
            context = grams[k][todo] >> 8
            at = np.minimum(np.searchsorted(nodes, context), len(nodes) - 1)
            known = nodes[at] == context
            todo, at = todo[known], at[known]
            edge = np.minimum(np.searchsorted(edges, grams[k][todo]), len(edges) - 1)
            hit = edges[edge] == grams[k][todo]
            old = started[todo]
            done = todo[hit]
            cost[done] += np.where(old[hit], base_x[done], self.base[k][at[hit]]) - self.bits[k][edge[hit]]
            open_[done] = False
            away, at = todo[~hit], at[~hit]
            cost[away] += np.where(old[~hit], escape_x[away], self.escape[k][at])
            base_x[away], escape_x[away], started[away] = self.base_x[k][at], self.escape_x[k][at], True
        cost[open_] += self.last
        return cost


class Model:
    """Context trees by language. name tells models apart in a worker."""

    def __init__(self, counts: dict[str, dict[str, int]], name: str):
        self.name, self.languages = name, sorted(counts)
        self.trees = [ContextTree(counts[x]) for x in self.languages]


#: Letters of a word that is remembered, at most; bytes of a longer one that are costed at once.
LONGEST, PART = 64, 1 << 16


class Scorer:
    """Costs of words under a model: a matrix row per word, at most memo words of LONGEST letters at once.

    Longer words (a line in a script without spaces is one) are costed part by part and not remembered.
    """

    def __init__(self, model: Model, memo: int = 400_000):
        self.model, self.memo = model, max(1, min(memo, 4_000_000 // (len(model.languages) + 1)))
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages) + 1))

    def _bits(self, flat: np.ndarray, depth: np.ndarray, coded: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        """A row per word: bits by language, and bytes, of the coded ones of flat; depth: how many bytes of its word are before each."""
        made = np.zeros((words, len(self.model.languages) + 1))
        grams = [flat]
        for k in range(1, ORDER + 1):
            longer = grams[-1].copy()
            longer[k:] += flat[:-k] << 8 * k
            grams.append(longer)
        grams, depth = [g[coded] for g in grams], depth[coded]
        for i, tree in enumerate(self.model.trees):
            made[:, i] = np.bincount(word, tree.cost(grams, depth), words)
        made[:, -1] = np.bincount(word, minlength=words)
        return made

    def learn(self, words: list[str]) -> None:
        codes = [_coded(w) for w in words]
        flat = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64)
        sizes = np.array([len(c) for c in codes], np.int64)
        starts = np.cumsum(sizes) - sizes
        depth = np.arange(len(flat)) - np.repeat(starts, sizes)
        coded = np.flatnonzero(depth > 0)  # the opening space is given
        made = self._bits(flat, depth, coded, np.repeat(np.arange(len(words)), np.maximum(sizes - 1, 0)), len(words)) if len(flat) else np.zeros((len(words), self.rows.shape[1]))
        self.at.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.rows = np.concatenate([self.rows, made])

    def _long(self, word: str) -> np.ndarray:
        flat = np.frombuffer(_coded(word), np.uint8)
        total = np.zeros(self.rows.shape[1])
        for start in range(1, len(flat), PART):
            first = max(0, start - ORDER)
            part = flat[first : start + PART].astype(np.int64)
            coded = np.arange(start - first, len(part))
            total += self._bits(part, np.arange(first, first + len(part)), coded, np.zeros(len(coded), np.int64), 1)[0]
        return total

    def _add(self, group: list[tuple[int, list[str]]], total: np.ndarray) -> None:
        """Add the words' costs to their texts' rows of total. A group has at most memo words."""
        if len(self.at) > self.memo:
            self.at, self.rows = {}, self.rows[:0]
        new = [w for w in dict.fromkeys(w for _, words in group for w in words) if w not in self.at and len(w) <= LONGEST]
        if new:
            self.learn(new)
        get = self.at.get
        for i, words in group:
            at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            known = at >= 0
            if not known.all():
                for j in np.flatnonzero(~known):
                    total[i] += self._long(words[j])
                at = at[known]
            total[i] += self.rows[at].sum(0)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its posterior probability, and bits for each coded byte, of each text."""
        total = np.zeros((len(texts), self.rows.shape[1]))
        group, words = [], 0
        for i, t in enumerate(texts):
            split = letters(t) if t else []
            for start in range(0, len(split), self.memo):  # a part of a text only where it alone is more than a memo
                part = split[start : start + self.memo]
                if words + len(part) > self.memo:
                    self._add(group, total)
                    group, words = [], 0
                group.append((i, part))
                words += len(part)
        self._add(group, total)
        cost, size = total[:, :-1], total[:, -1]
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = cost.argmin(1)
        least = cost.min(1)
        weight = np.exp2(-np.minimum(cost - least[:, None], 1000)).sum(1)
        known = size > 0
        names = [self.model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.where(known, 1 / weight, 0.0), np.where(known, least / np.maximum(size, 1), 0.0)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_docs: int = 400, max_bytes: int = 1 << 20, total_bytes: int = 64 << 20) -> Model:
    """Train on a bounded sample of the labelled rows of docs. Every language is learned.

    The bounds, the same at every input size: of each language the first max_docs documents by hash of id
    and text, as whole texts, while they have at most its share together: max_bytes, or an equal part of total_bytes
    where the languages are too many for that. Texts over an eighth of the share come after all others, the
    shortest first, so that none shuts out those after it; a language has one document at least. Rows with
    null lang, null text or an empty text teach nothing.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(key).alias("id"), F.col(text).alias("text")).where("lang is not null and length(text) > 0")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    known = sizes.withColumn("share", F.least(F.lit(float(max_bytes)), F.lit(float(total_bytes)) / F.count("*").over(Window.partitionBy())))  # a row for each language, as the model has a tree
    draw = F.pmod(F.xxhash64("id", "text", F.lit(7)), F.lit(1 << 30))  # of the text too: rows may share an id, or have none
    # about twice max_docs rows of each language pass; an exact count follows on what is left
    near = rows.join(F.broadcast(known), "lang").withColumn("draw", draw).where(F.col("draw") * F.col("n") < F.lit(float((1 << 30) * max_docs * 2)) + F.lit(float(1 << 30)) * 20)
    size = F.octet_length("text")
    near = near.withColumn("long", F.when(size * 8 > F.col("share"), size).otherwise(0))
    order = Window.partitionBy("lang").orderBy("long", "draw", "id", "text")
    near = near.withColumn("at", F.row_number().over(order)).withColumn("bytes", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.where((F.col("at") <= max_docs) & ((F.col("bytes") <= F.col("share")) | (F.col("at") == 1)))
    counts: dict[str, Counter] = {}
    for row in near.select("lang", "text").collect():  # at most total_bytes, and a language's only document
        counts.setdefault(row["lang"], Counter()).update(letters(row["text"]))
    import hashlib

    name = hashlib.sha256(repr(sorted((k, sorted(v.items())) for k, v in counts.items())).encode()).hexdigest()
    return Model(counts, name)


NAMES = ("lang_pred", "score", "bits_per_byte")


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs with lang_pred, score (the language's posterior probability, even priors) and bits_per_byte, called as names says.

    Narrow. Null text, or text without a letter: und, 0, 0. Ties go to the first language by name. Without
    any labelled text all is und. Columns of these names are replaced; repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as fit() says
    fields = [T.StructField(n, t, False) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)]

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        common.sole_memo("langid", _live.clear)
        name = shared.value.name
        if name not in _live:
            _live.clear()
            _live[name] = Scorer(shared.value)
        found, score, bits = _live[name].score(common.texts_of(part, text))
        return [pa.array(found, pa.string()), pa.array(score), pa.array(bits)]

    return common.add_columns(docs, fields, compute, text, keep)


def rejected(bits_limit: float = 8.0, names: tuple[str, str, str] = NAMES):
    """Documents in no learned language: und, or coded no better than raw bytes."""
    return (F.col(names[0]) == UNKNOWN) | (F.col(names[2]) >= bits_limit)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned from the folds that aren't held out.

    Null texts and those without a letter are und; ties go to the first language by name; repeated rows each have their row.
    """
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(common.fold("doc_id", 3) != 1))
    return identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")
