"""Mixing sources to target weights (operator 2), in DataFrame functions only.

Documents hash into blocks of about block_words words within their source (larger ones where that would make
more than most_blocks of it). A source's blocks lie in a keyed order; a pass takes its first blocks up to the source's quota of words, the last one in part. The
exact block quotas then go down a splitting tree: a node halves its shards and draws, source by source,
how many of its blocks go left, from the multivariate hypergeometric distribution; so each shard has exact
quotas, drawn as if all blocks had been shuffled, from one small row per node. Shards draw their quotas as
disjoint runs of the keyed order; rows shuffle locally by a keyed position within their shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import common

WEIGHTS = (5, 2, 1)
#: Rows of a plan (sources, blocks) that are sent to all tasks, 20 MB; a larger one is joined by shuffle.
MOST_BROADCAST = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def _own(key: str, text: str, source: str) -> dict[str, Column]:
    """What a row is known by: id, source, size (words of the text; null text has none) and the text's hash."""
    return {"id": F.col(key), "source": F.col(source), "size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"), "hash": F.xxhash64(text)}


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, hash) for each row of docs."""
    return docs.select(*[c.alias(name) for name, c in _own(key, text, source).items()])


def _sent(table: DataFrame) -> DataFrame:
    """A written table for joins with all rows: broadcast up to a bound."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, docs, weight, target) for each source.

    Sources by code point, null last, weigh weights in turn, and share share x all sizes. A target stops at
    most x its source's size; the excess is shared anew by weight until none is above: filling sources up in
    the order of size / weight, every one below its limit gets the same amount for each unit of weight.
    One row per source is all that meets in one task here.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # the first source that stays below its limit fixes the level for all after it
    filled = weighed.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") < F.col("limit"))
    fixed = F.first(F.when(F.col("below"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, 0))
    return filled.select("source", "source_size", "docs", "weight", F.coalesce(F.least(fixed * F.col("weight"), F.col("limit")), F.col("limit")).alias("target"))


def _ln_factorial(x: Column) -> Column:
    """Stirling's series; exact to 1e-6, which no draw can tell."""
    z = x + F.lit(2.0)
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return series - F.log(x + F.lit(1.0))


def _hypergeometric(u: Column, good: Column, all_: Column, drawn: Column) -> Column:
    """How many of drawn balls, out of all_ with good good ones, are good: the u-quantile (u in 0 to 1)."""
    low = F.greatest(F.lit(0), drawn - (all_ - good))
    high = F.least(good, drawn)
    choose = lambda n, k: _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
    start = F.struct(low.cast("long").alias("x"), F.lit(0.0).alias("sum"))
    step = lambda acc, k: F.struct(F.when(acc["sum"] < u, k).otherwise(acc["x"]).cast("long").alias("x"), (acc["sum"] + F.exp(choose(good, k) + choose(all_ - good, drawn - k) - choose(all_, drawn))).alias("sum"))
    return F.aggregate(F.sequence(low, high), start, step)["x"]


def splitting_tree(spark: SparkSession, quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(shard, source, pass, taken): the block quotas (source, pass, quota) split over 2 ** depth shards.

    Sums are exact: per source and pass over the shards, and shard totals differ by one at most.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("source", "pass", "quota"))).alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda acc, q: acc + q["quota"])
        node = node.withColumn("total", total).withColumn("half", F.floor((F.col("total") + 1) / 2).cast("long"))
        start = F.struct(F.lit(0).alias("at"), F.col("total").alias("all"), F.col("half").alias("drawn"), F.expr("cast(array() as array<bigint>)").alias("left"))

        key = F.lit(level)

        def draw(acc, q):
            u = (F.pmod(F.xxhash64(F.lit(seed), key, F.col("node"), acc["at"]), F.lit(1 << 40)) + 0.5) / float(1 << 40)
            x = F.when(q["quota"] == 0, F.lit(0).cast("long")).otherwise(_hypergeometric(u, q["quota"], acc["all"], acc["drawn"]))
            return F.struct((acc["at"] + 1).alias("at"), (acc["all"] - q["quota"]).alias("all"), (acc["drawn"] - x).alias("drawn"), F.concat(acc["left"], F.array(x)).alias("left"))

        node = node.withColumn("left", F.aggregate("quotas", start, draw)["left"])
        left = F.zip_with("quotas", "left", lambda q, n: F.struct(q["source"].alias("source"), q["pass"].alias("pass"), n.alias("quota")))
        right = F.zip_with("quotas", "left", lambda q, n: F.struct(q["source"].alias("source"), q["pass"].alias("pass"), (q["quota"] - n).alias("quota")))
        node = node.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))).alias("x")).select("x.*")
    return node.select(F.col("node").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.source", "q.pass", F.col("q.quota").alias("taken"))


#: Draws of a block that isn't drawn.
_EMPTY = "cast(array() as array<struct<pass:int,budget:bigint,shard:bigint>>)"


class Plan:
    """What the mix takes of which block, from the sizes of all rows; tables in the shared folder.

    targets: a row for each source with its size, target and number of blocks. blocks: a row for each drawn
    (source, block): draws (pass, budget, shard), and whether some draw ends inside of it (cut). One block
    of a source and pass is cut at most.
    """

    def __init__(self, sizes: DataFrame, weights: tuple[int, ...], share: float, most: int, block_words: int, most_blocks: int, depth: int, seed: int):
        self.seed = seed
        spark = sizes.sparkSession
        plan = targets(sizes, weights, share, most).withColumn("blocks", F.greatest(F.lit(1), F.least(F.lit(most_blocks), F.ceil(F.col("source_size") / block_words))).cast("long"))
        self.targets = common.materialize(plan.select("source", "source_size", "target", "blocks"), "targets")
        self._targets = _sent(self.targets.withColumnRenamed("source", "target_source"))

        # blocks in their source's keyed order, with the words that lie before each: at most most_blocks rows per source
        keyed = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
        blocks = self.placed(sizes).groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
        blocks = blocks.withColumn("rank", F.row_number().over(keyed)).withColumn("start", F.sum("words").over(keyed) - F.col("words"))
        passes = F.sequence(F.lit(1), F.lit(most))
        drawn = blocks.select("source", "block", "words", "rank", "start", F.explode(passes).alias("pass"), F.floor("target").cast("long").alias("whole"), "source_size")
        drawn = drawn.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("source_size"), F.col("whole") - F.col("source_size") * (F.col("pass") - 1))))
        drawn = drawn.withColumn("budget", F.greatest(F.lit(0), F.least(F.col("words"), F.col("quota") - F.col("start")))).where("budget > 0")
        drawn = common.materialize(drawn.select("source", "block", "pass", "words", "budget", "rank"), "blocks")

        # which shard each drawn block goes to
        split = splitting_tree(spark, drawn.groupBy("source", "pass").agg(F.count("*").alias("quota")), depth, seed)
        runs = Window.partitionBy("source", "pass").orderBy("shard")
        split = split.withColumn("last", F.sum("taken").over(runs)).withColumn("first", F.col("last") - F.col("taken") + 1).where("taken > 0")
        sharded = drawn.alias("d").join(split.alias("s"), F.expr("d.source <=> s.source and d.pass = s.pass and d.rank between s.first and s.last")).select("d.source", "d.block", "d.pass", "d.words", "d.budget", "s.shard")
        per_block = sharded.groupBy("source", "block").agg(F.first("words").alias("words"), F.collect_list(F.struct("pass", "budget", "shard")).alias("draws"))
        cut = F.exists("draws", lambda d: d["budget"] < F.col("words"))
        self.blocks = common.materialize(per_block.select(F.col("source").alias("block_source"), F.col("block").alias("block_number"), "draws", cut.alias("cut")), "shards")
        self._blocks = _sent(self.blocks)

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (id, source, size, hash and others) with source_size, target and block."""
        met = rows.join(self._targets, F.col("source").eqNullSafe(F.col("target_source")))
        return met.withColumn("block", F.pmod(F.xxhash64(F.lit(self.seed), "id", "size", "hash"), F.col("blocks"))).drop("blocks", "target_source")

    def met(self, rows: DataFrame) -> DataFrame:
        """rows with source_size, target, block, draws (null in blocks that aren't drawn) and cut."""
        return self.placed(rows).join(self._blocks, F.col("source").eqNullSafe(F.col("block_source")) & (F.col("block") == F.col("block_number")), "left").drop("block_source", "block_number")

    def before(self, rows: DataFrame) -> DataFrame:
        """Rows of cut blocks with the words that lie before each in its block's keyed order. A block's rows without their texts meet in one task."""
        inner = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(self.seed + 2), "id"), "id", "size", "hash").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("before", F.sum("size").over(inner) - F.col("size"))

    def taken(self, before: Column, cut: Column) -> Column:
        """Draws of a row: pass, words, shard, position (ascending order within a shard is the local shuffle)."""
        room = lambda d: F.when(cut, F.greatest(F.lit(0), F.least(F.col("size"), d["budget"] - before))).otherwise(F.col("size"))
        made = F.transform(F.coalesce("draws", F.expr(_EMPTY)), lambda d: F.struct(d["pass"].alias("pass"), room(d).cast("long").alias("words"), d["shard"].alias("shard"), F.xxhash64(F.lit(self.seed + 3), "id", "hash", d["pass"]).alias("position")))
        return F.sort_array(F.filter(made, lambda d: d["words"] > 0))


def planned(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block_words: int = 50_000, most_blocks: int = 20_000, depth: int = 4, seed: int = 20) -> Plan:
    """The plan over sizes, which is written already. most_blocks bounds what is ordered in one task for a source; 2 ** depth shards."""
    return Plan(sizes, weights, share, most, block_words, most_blocks, depth, seed)


def draws(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, draws.

    draws has an element for each pass in which the mix takes words of the row: pass (1 to most), words,
    shard, position. options: those of planned().

    A source's words over all passes are its target, cut to a whole number; the document at the cut gives
    its first words. No document is taken more than most times. Null text has size 0 and is never taken;
    null sources are one source, the last; null keys and repeated rows are rows like others. Ties in
    the keyed order (repeated rows) are interchangeable. Reruns give the same rows.
    """
    sizes = common.materialize(sized(docs, key, text, source), "sizes")
    plan = planned(sizes, **options)
    met = plan.met(sizes)
    cut = plan.before(met.where("cut"))
    all_ = cut.unionByName(met.where("not coalesce(cut, false)").withColumn("before", F.lit(0).cast("long")))
    return all_.select("id", "source", "size", "source_size", "target", plan.taken(F.col("before"), F.col("cut")).alias("draws"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", names: tuple[str, str] = ("mix_shard", "mix_position"), **options) -> DataFrame:
    """The rows of docs that the mix takes, once for each pass, with their shard and position, called as names says.

    Documents aren't torn: the one at a source's cut comes whole if at least half of its words are taken
    in that pass. Wordless documents are never taken. Columns of docs with these names are replaced. Texts
    only move where a block is cut or the plan is beyond what is sent to all tasks.
    """
    docs = docs.drop(*names)
    sizes = common.materialize(sized(docs, key, text, source), "sizes")
    plan = planned(sizes, **options)
    own = ["id", "source", "size", "hash"]
    # all of a row beside what the plan calls its own, so that no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in _own(key, text, source).items()])
    met = plan.met(rows)
    nth = F.row_number().over(Window.partitionBy(*own).orderBy("block"))  # tells repeated rows apart
    few = plan.before(plan.met(sizes).where("cut"))
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy("before"))).select(*[F.col(c).alias(f"{c}_") for c in own], "nth", "before")
    cut = met.where("cut").withColumn("nth", nth).alias("m").join(few.alias("f"), F.expr(" and ".join(f"m.{c} <=> f.{c}_" for c in own) + " and m.nth = f.nth")).select("m.*", "before")
    whole = met.where("not cut").withColumns({"nth": F.lit(0), "before": F.lit(0).cast("long")})
    some = lambda df: df.withColumn("draw", F.explode(F.filter(plan.taken(F.col("before"), F.col("cut")), lambda d: d["words"] * 2 >= F.col("size")))).select("row.*", F.col("draw.shard").alias(names[0]), F.col("draw.position").alias(names[1]))
    return some(whole).unionByName(some(cut))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: size, its source's size and target, words taken. Nulls, empty texts, ties and repeated rows: as draws() says."""
    rows = draws(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, d: acc + d["words"])
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))
