"""The pipeline's stages on odd tables, and run() against a plain reading of its stages."""

import re
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from spindrift.llm import bpe, common, langid, mixing, secrets
from test_llm import brute_components

STAGES = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score", "bits_per_byte", "lang_pred", "mix_shard", "mix_position", "kept", "component_id", "n_shingles", "size", "secret_spans", "id", "hash", "row", "block")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id with two texts, and columns of the operators' names."""
    english = "the quick brown fox jumps over the lazy dog and runs into the dark green forest again "
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, english + "without an id", "en", None, 90), (None, english + "without an id", "en", None, 90),
        (4, english * 3000, "en", "a", 1), (5, english, "en", "a", 1), (5, english, "en", "a", 1), (6, "12345 !!!", None, "b", 9), (7, "x", "en", "b", 1),
        (8, english + "one more", None, "b", 1), (8, "der hund und die katze laufen schnell durch den grünen wald zum haus", "de", "b", 1), (9, english + "token=" + "0123abcd" * 5, "en", "b", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, odd, name):
    out = STAGES[name](spark, odd.where("false"), "")
    assert out.count() == 0
    if name != "bpe_tokens":
        assert out.columns == odd.columns


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_own_columns_stay(spark, odd, name):
    out = STAGES[name](spark, odd, "")
    assert out.columns == odd.columns
    for r in out.collect():
        assert all(r[c] == f"own {c}" for c in CLASH)


def test_language_on_odd_rows(spark, odd):
    kept = rows_of(STAGES["language_id"](spark, odd, "").select("doc_id", "lang"))
    assert not any(i in (1, 2, 3, 6) for i, _ in kept) and kept[5, "en"] == 2 and kept[None, "en"] == 2 and kept[8, "en"] == kept[8, "de"] == 1


def test_near_duplicates_on_odd_rows(spark, odd):
    out = Counter(r.doc_id for r in STAGES["near_duplicates"](spark, odd, "").collect())
    # of the repeated row one stays; both texts of id 8 stay or go together; rows without an id, null and wordless texts stay
    assert out[5] == 1 and out[None] == 2 and out[1] == out[2] == out[3] == 1 and out[8] in (0, 2)


def test_different_texts_of_an_id_stay(spark):
    docs = spark.createDataFrame([(1, "one text of five words or more", "en", "a", 1), (1, "another text that has its own words", "en", "a", 1), (1, "one text of five words or more", "en", "b", 1)], DOCS)
    out = STAGES["near_duplicates"](spark, docs, "").collect()
    assert sorted(r.text for r in out) == ["another text that has its own words", "one text of five words or more"] and {r.source for r in out} == {"a"}


def test_secrets_on_odd_rows(spark, odd):
    out = STAGES["secrets"](spark, odd, "").collect()
    assert len(out) == odd.count()
    (r,) = (r for r in out if r.doc_id == 9)
    assert "[SECRET]" in r.text and "0123abcd" not in r.text and r.n_chars == len(r.text)
    (r,) = (r for r in out if r.doc_id == 1)
    assert r.text is None and r.n_chars is None


def test_mixing_on_odd_rows(spark, odd):
    out = Counter(r.doc_id for r in STAGES["mixing"](spark, odd, "").collect())
    want = Counter()
    for r in mixing.draws(odd).collect():
        want[r.id] += sum(d.words * 2 >= r["size"] for d in r.draws)
    assert out == +want and not out.keys() & {1, 2, 3}


def test_tokens_on_odd_rows(spark, odd):
    out = [(r.doc_id, r.n_tokens) for r in STAGES["bpe_tokens"](spark, odd, "").collect()]
    assert len(out) == odd.count() and (1, 0) in out and (2, 0) in out


def test_run_against_a_plain_reading(spark, sf):
    docs = common.table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf).collect()
    # language ID: whole code lengths under the model, added word by word
    model = langid.fit(docs)
    scorer, kept = langid.Scorer(model), []
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if words:
            scorer.learn([w for w in dict.fromkeys(words) if w not in scorer.at])
            total = sum(scorer.rows[scorer.at[w]] for w in words)
            if total[:-1].min() / total[-1] < 8:
                kept.append(r.asDict() | {"lang": r.lang or model.languages[total[:-1].argmin()]})
    # near-duplicates: all pairs of whole sets
    roots = brute_components({r["doc_id"]: r["text"] for r in kept}, 5)
    kept = {r["doc_id"]: r for r in kept if roots[r["doc_id"]][1] == r["doc_id"]}
    before = spark.createDataFrame([tuple(r.values()) for r in kept.values()], docs.schema)
    # secrets: spans cut out by hand
    scanner = secrets.fit(before)
    for r in kept.values():
        text, cut = r["text"], [False] * len(r["text"])
        for start, _, end in scanner.scan(text):
            cut[start:end] = [True] * (end - start)
        starts = {s for s, _, _ in scanner.scan(text)}
        r["text"] = "".join("[SECRET]" if i in starts and (i == 0 or not cut[i - 1]) else "" if cut[i] else c for i, c in enumerate(text))
    # mixing: how often each document is drawn
    after = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in kept.values()], "doc_id long, text string, source string")
    times = Counter()
    for r in mixing.draws(after).collect():
        times[r.id] += sum(d.words * 2 >= r["size"] for d in r.draws)
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    assert Counter(r.doc_id for r in out) == +times and len(out) > 100
    for r in out:
        doc = kept[r.doc_id]
        assert (r.lang, r.source, r.ids) == (doc["lang"], doc["source"], real.encode_ordinary(doc["text"])) and r.n_tokens == len(r.ids)
