"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. Models are learned from the stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import bpe, common, dedup, langid, mixing, secrets
from spindrift.operators import storage


#: What a stage adds for itself, by names that no column of documents has.
_FOUND = ("__lang_pred", "__lang_score", "__lang_bits")
_DRAWN = ("__mix_shard", "__mix_position")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go (null and empty texts too); a missing lang is filled with the predicted one.

    Without any labelled text every document goes. Repeated rows stay or go together; other columns stay as they are.
    """
    found = langid.identify(docs, langid.fit(docs), names=_FOUND).where(~langid.rejected(names=_FOUND))
    return found.withColumn("lang", F.coalesce("lang", _FOUND[0])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays: that of the smallest id.

    Of rows that repeat id and text one stays, the first by source and lang; different texts of the id that stays all
    stay. Rows without an id stay, as do wordless ones.
    """
    kept = dedup.near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    first = Window.partitionBy("doc_id", "text").orderBy("source", "lang")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, null texts and repeated rows too; secrets in texts give way to a mark, and n_chars follows."""
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in shards, each shuffled: a shard lies in up to 64 files of one keyed range each.

    Wordless texts are never drawn; null sources are one source, null ids and repeated rows are rows like others.
    """
    mixed = mixing.mixed(docs, names=_DRAWN).withColumn("__range", F.shiftrightunsigned(_DRAWN[1], 58))
    return mixed.repartition(_DRAWN[0], "__range").sortWithinPartitions(*_DRAWN).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each drawn document; none for a null or empty text."""
    import public_tokenizers

    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids"), keep=["doc_id", "lang", "source"])


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("secrets", redact_secrets), ("mixing", mix), ("bpe_tokens", tokens)]

#: SQL can express neither the trained models nor the keyed draws; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again. Its other tables go then, and those rows before."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with storage.scratch() as made:
            after = common.materialize(stage(spark, docs, sf_dir), name)
        common.discard(docs, *[table for table in made if table is not after])
        docs = after
    return docs
