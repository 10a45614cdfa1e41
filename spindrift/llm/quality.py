"""Quality rules (operator 6): robust multivariate outliers by minimum covariance determinant.

Each text gives word and symbol statistics; transformed, they are a point. Within each language and source
the mean and covariance of the h most central points (minimum covariance determinant) are found by
concentration steps from a robust start: distances under the present estimate, the h nearest points, their
mean and covariance. A step is one aggregate over all points: points fall into fine distance classes with
counts and moments per class, and the classes up to h make the next estimate. No point is sampled and no
group is collected; groups only meet as class sums. Documents far out by Mahalanobis distance are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import common

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Distance classes per octave of the squared distance, and their range in octaves.
FINE, OCTAVES = 24, (-20, 40)
#: Groups whose estimates may be broadcast, 30 MB.
MOST_BROADCAST = 100_000
#: Squared-distance quantile 0.5 of the chi-squared distribution with 4 degrees of freedom (fixed value).
CHI2_MEDIAN_4 = 3.3567


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    if not words:
        return 0, 0, 0, 0, 0
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(joined.translate(None, _NOT_SYMBOLS))
    lines = text.split(b"\n")
    duplicate = 0
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                duplicate += bool(line.split())
            else:
                seen.add(line)
    repeat = 0
    n = len(words)
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        size = len(number)
        if size < 2_000_000:
            windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        else:  # three numbers no longer fit one integer
            pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * size + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            covered[:-2] |= twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeat = int(covered.sum())
    return n, chars, symbols, duplicate, repeat


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the five statistics. Narrow; null text counts as none."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        rows = [statistics(t) for t in common.bytes_of(part, text)]
        return [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]

    return common.add_columns(docs, [T.StructField(name, T.LongType(), False) for name in STATS], compute, text, keep)


def point() -> list[Column]:
    """The transformed statistics: log word length, and square roots of the symbol, repeated-line and repeated-word densities."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.sqrt(F.col("n_symbols") / words), F.sqrt(F.col("n_dup_lines") / words), F.sqrt(F.col("n_repeat_words") / words)]


#: Spread in each coordinate below which differences say nothing about quality: added to each variance.
FLOOR = (0.05, 0.05, 0.05, 0.10)
_D = len(FLOOR)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]


def _solved(groups: DataFrame) -> DataFrame:
    """Rows (g, n, sums, products) to (g, mean, inverse): floor-regularised, inverse as the upper triangle."""

    def run(batches):
        for batch in batches:
            out_mean, out_inverse = [], []
            for n, sums, products in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                mean = np.array(sums) / n
                cov = np.zeros((_D, _D))
                for (i, j), p in zip(_PAIRS, products, strict=True):
                    cov[i, j] = cov[j, i] = p / n - mean[i] * mean[j]
                inverse = np.linalg.inv((cov + cov.T) / 2 + np.diag(np.square(FLOOR)))
                out_mean.append(mean.tolist())
                out_inverse.append([float(inverse[i, j]) for i, j in _PAIRS])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_mean, pa.list_(pa.float64())), pa.array(out_inverse, pa.list_(pa.float64()))], names=["g", "mean", "inverse"])

    return groups.select("g", F.col("n").cast("double"), "sums", "products").mapInArrow(run, "g string, mean array<double>, inverse array<double>")


def _distance() -> Column:
    away = [F.col(f"x{i}") - F.col("mean")[i] for i in range(_D)]
    return sum(((1 if i == j else 2) * F.col("inverse")[k] * away[i] * away[j] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(_D)]
    return [F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("sums"), F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("products")]


def estimates(points: DataFrame, central: float = 0.75, steps: int = 5, few: bool = False) -> DataFrame:
    """(g, mean, inverse, scale): the MCD estimate of each group g of points (g, x0..x3). A row may stand in several groups.

    central: the part of a group's points that the estimate rests on. scale makes the median squared
    distance that of a normal distribution. few: there are at most MOST_BROADCAST groups, so a step's estimates (300
    bytes each) go to all tasks; else they are joined by shuffle.
    """
    median = F.percentile_approx
    sent = F.broadcast if few else lambda df: df
    start = points.groupBy("g").agg(F.array(*[median(f"x{i}", 0.5, 1000) for i in range(_D)]).alias("mean"), F.array(*[median(f"x{i}", 0.75, 1000) - median(f"x{i}", 0.25, 1000) for i in range(_D)]).alias("range"))
    spread = [(F.col("range")[i] / 1.349) * (F.col("range")[i] / 1.349) + FLOOR[i] ** 2 for i in range(_D)]
    now = start.select("g", "mean", F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i, j in _PAIRS]).alias("inverse"))
    upward = Window.partitionBy("g").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # at most FINE x 60 classes
    for _ in range(steps):
        classed = points.join(sent(now), "g").withColumn("class", F.floor(F.log2(F.greatest(F.least(_distance(), F.lit(2.0 ** OCTAVES[1])), F.lit(2.0 ** OCTAVES[0]))) * FINE).cast("int"))
        classes = classed.groupBy("g", "class").agg(*_moments())
        total = F.sum("n").over(Window.partitionBy("g"))
        # the class that crosses h counts in the part that is needed
        need = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total * central - F.coalesce(F.sum("n").over(upward), F.lit(0))) / F.col("n")))
        used = classes.withColumn("part", need).where("part > 0")
        sums = used.groupBy("g").agg(F.sum(F.col("n") * F.col("part")).alias("n"), F.array(*[F.sum(F.col("sums")[i] * F.col("part")) for i in range(_D)]).alias("sums"), F.array(*[F.sum(F.col("products")[k] * F.col("part")) for k in range(len(_PAIRS))]).alias("products"))
        now = _solved(sums)
    now = common.materialize(now, "centers")
    scale = points.join(sent(now), "g").groupBy("g").agg(F.greatest(F.lit(1.0), median(_distance(), 0.5, 1000) / CHI2_MEDIAN_4).alias("scale"))
    return now.join(scale, "g")


def judge(docs: DataFrame, limit: float = 60.0, least_group: int = 50, min_words: int = 50, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """(key, the five statistics, base_failed, distance, kept) for each row of docs.

    base_failed: fewer than min_words words, or over half of the words in repeated three-word windows.
    distance: squared Mahalanobis distance from the row's group: its language and source if least_group
    rows that didn't fail have both, else its language, else all rows. kept: neither failed nor with a
    distance over limit. Estimates come from the rows that didn't fail; without any, distance is null and
    failing alone decides. Null text counts as none; null lang or source are values like others.
    """
    stats = common.materialize(measured(docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")), "text", ["id", "lang", "source"]), "statistics")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumns({f"x{i}": x for i, x in enumerate(point())})
    name = lambda *parts: F.to_json(F.struct(*[F.coalesce(F.col(p), F.lit("\0")).alias(p) for p in parts]))
    stats = stats.withColumn("fine", name("lang", "source")).withColumn("coarse", name("lang"))
    # a row for each language and source: the group that judges it, its own if that is large enough
    good = F.col("good")
    sizes = stats.groupBy("fine", "coarse").agg(F.count_if(~F.col("base_failed")).alias("good")).withColumn("all", F.sum(good).over(Window.partitionBy("coarse")))
    group = F.when(good >= least_group, F.col("fine")).when(F.col("all") >= least_group, F.col("coarse")).otherwise(F.lit("all"))
    sizes = common.materialize(sizes.select("fine", good, group.alias("g")), "groups")
    few = sizes.count() <= MOST_BROADCAST
    sent = F.broadcast if few else lambda df: df
    xs = [f"x{i}" for i in range(_D)]
    stats = common.materialize(stats.join(sent(sizes.select("fine", "g")), "fine").select("id", *STATS, "base_failed", *xs, "g", "fine", "coarse"), "points")
    # an estimate rests on all rows of its group, also on those that a smaller group judges
    needed = sizes.where(good > 0).select("g").distinct()
    among = stats.where(~F.col("base_failed")).select(*xs, F.explode(F.array("fine", "coarse", F.lit("all"))).alias("g")).join(sent(needed), "g")
    found = common.materialize(estimates(among, few=few, **options), "estimates")
    out = stats.join(sent(found), "g", "left").withColumn("distance", _distance() / F.col("scale"))
    return out.select(F.col("id").alias(key), *STATS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every whole text of documents. A null or empty text has no words, so it fails the base and isn't
    kept; rows without a language or source are a group of their own; repeated rows each have their row; an empty table gives none."""
    return judge(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
