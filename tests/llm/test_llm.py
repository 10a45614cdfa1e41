"""The llm operators against brute force, round trips and planted cases, with nulls, ties, empty tables and clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers as P
from spindrift.llm import bpe, components, dedup, embeddings, langid, mixing, ngram_lm, pii, quality, queries, secrets, urls

RANKS_PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(RANKS_PATH, "rb").read())
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows."""
    long = "the and of " * 20_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 5), (None, "no id here at all", "en", None, 17), (4, long, "en", "a", len(long)), (5, "the same row", "en", "a", 12), (5, "the same row", "en", "a", 12), (6, "12345 !!! ???", None, "b", 13), (7, "x", "de", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# BPE

@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab thé's \n\t\x1c\x85\xa0 12٣ß中😀!?.İ"), max_size=60))
def test_bpe_equals_library(text):
    codec = bpe.Codec(RANKS, P.PATTERN)
    ids = codec.encode(text)
    assert ids == REAL.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_long_piece_and_memo():
    codec = bpe.Codec(RANKS, P.PATTERN, memo=5)
    text = "ab" * 30_000 + " " + " ".join(map(str, range(50))) * 2
    assert codec.encode(text) == REAL.encode_ordinary(text) and len(codec.pieces) <= 5


def test_bpe_query(spark, sf, texts):
    for r in queries.queries()["op10_byte_bpe"](spark, sf).collect():
        ids = REAL.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_odd(odd, nothing):
    out = bpe.tokenize(odd.withColumn("ids", F.lit("clash")), RANKS_PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids"]
    got = Counter((r.doc_id, r.n_tokens) for r in out.collect())
    assert got[(1, 0)] == got[(2, 0)] == 1 and got[(5, 3)] == 2
    assert bpe.tokenize(nothing, RANKS_PATH, P.PATTERN).count() == 0


# language ID

def test_langid_held_out(spark, sf, documents):
    out = queries.queries()["op1_language"](spark, sf).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out))


def plain_ppm(words: dict[str, int], word: str, order: int) -> float:
    """Code length by a direct reading of the definition: walk down from the longest known context, excluding."""
    def seen(context: bytes) -> Counter:
        c = Counter()
        for w, n in words.items():
            code = b" " + w.encode() + b" "
            for at in range(1, len(code)):
                if at >= len(context) and code[at - len(context) : at] == context:
                    c[code[at]] += n
        return c

    code, bits = b" " + word.encode() + b" ", 0.0
    for at in range(1, len(code)):
        excluded, done = set(), False
        for k in range(min(order, at), -1, -1):
            c = seen(code[at - k : at])
            if not c:
                continue
            live = {s: n for s, n in c.items() if s not in excluded}
            total, kinds = sum(live.values()), len(live)
            if code[at] in live:
                bits -= math.log2(live[code[at]] / (total + kinds))
                done = True
                break
            if kinds:
                bits -= math.log2(kinds / (total + kinds))
            excluded |= set(c)
        if not done:
            bits += math.log2(256 - len(excluded))
    return bits


def test_langid_code_lengths():
    words = {"abra": 3, "cadabra": 2, "bar": 1, "éa": 2}
    scorer = langid.Scorer(langid.Model({"x": words}, "n"))
    probe = ["abra", "bard", "zz", "éab", "cad", "a"]
    scorer.learn(probe)
    for i, w in enumerate(probe):
        assert scorer.rows[i, 0] == pytest.approx(plain_ppm(words, w, langid.ORDER), abs=1e-9)


def test_langid_learns_every_language(spark):
    rows = [(100 * k + i, f"l{k:02d}", " ".join(chr(0x4E00 + 40 * k + (7 * i + j) % 40) * 2 for j in range(12))) for k in range(70) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs)
    assert model.languages == sorted({r[1] for r in rows})
    assert all(r.lang == r.lang_pred for r in langid.identify(docs, model).collect())


def test_langid_shared_ids_shut_none_out(spark, monkeypatch):
    """Languages whose rows all have one id, or none, are learned like others, from as many documents."""
    monkeypatch.setattr(langid, "Model", lambda counts, name: counts)
    letters = "translate(id, '0123456789', 'abcdefghij')"
    docs = spark.range(14_000).selectExpr("nullif(id % 7, 0) as doc_id", "concat('l', id % 7) as lang", f"concat('word ', {letters}) as text")
    counts = langid.fit(docs)
    assert sorted(counts) == [f"l{k}" for k in range(7)] and {c["word"] for c in counts.values()} == {400}


def test_langid_long_texts_shut_none_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "Model", lambda counts, name: counts)
    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26) * 3
    rows = [(i, "a", f"{'long ' * 300_000 if i % 3 == 0 else ''}{word(i)}") for i in range(60)] + [(100, "b", "only " * 300_000)]
    counts = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert set(counts["a"]) == {word(i) for i in range(60) if i % 3} and set(counts["b"]) == {"only"}


def test_langid_groups_dont_matter():
    model = langid.Model({"a": Counter(["hund", "katze"]), "b": Counter(["dog", "cat"])}, "m")
    texts = ["hund und katze " * 5, None, "dog", "cat and dog and " * 4, ""]
    (names, *want), (others, *got) = (langid.Scorer(model, memo).score(texts) for memo in (1000, 3))
    assert names == others and all(np.allclose(x, y) for x, y in zip(want, got, strict=True))


def test_langid_long_words():
    """A word of any length costs what its definition says, and is not remembered."""
    model = langid.Model({"a": Counter(["hund", "katze"]), "b": Counter(["dog", "cat"])}, "m")
    word = "hundkatze" * 40_000 + "é"
    plain, parts = langid.Scorer(model), langid.Scorer(model)
    plain.learn([word])
    names, score, bits = parts.score([word, f"dog {word} cat"])
    assert not any(len(w) > langid.LONGEST for w in parts.at) and names == ["a", "a"]
    assert bits[0] == pytest.approx(plain.rows[0, :-1].min() / plain.rows[0, -1]) and plain.rows[0, -1] == len(word.encode()) + 1


def test_langid_query_brute(spark, sf, documents):
    """lang_pred and score of the query from plainly added code lengths."""
    docs = documents.collect()
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 for r in docs}
    model = langid.fit(documents.where(~F.col("doc_id").isin([i for i, f in fold.items() if f == 1])))
    got = {r.doc_id: r for r in queries.queries()["op1_language"](spark, sf).collect()}
    scorer = langid.Scorer(model)
    words = sorted({w for r in docs[:60] for w in re.findall(r"[^\W\d_]+", (r.text or "").lower())})
    scorer.learn(words)
    for r in docs[:60]:
        cost = sum((scorer.rows[scorer.at[w], :-1] for w in re.findall(r"[^\W\d_]+", (r.text or "").lower())), np.zeros(len(model.languages)))
        if not cost.any():
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
        else:
            assert got[r.doc_id].lang_pred == model.languages[cost.argmin()] and got[r.doc_id].score == pytest.approx(1 / np.exp2(cost.min() - cost).sum())


def test_langid_odd(odd, nothing):
    model = langid.fit(odd)
    out = {r.doc_id: r for r in langid.identify(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[6].lang_pred == "und" and out[6].score == 0 and out[4].lang_pred == "en"
    empty = langid.fit(nothing)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


# mixing

def fill(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Share 150 %, stop at twice, share the excess again until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, rest = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if level * weight[s] >= 2 * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in open_}
        for s in above:
            fixed[s] = 2.0 * sizes[s]
            rest -= fixed[s]


def test_mixing_query(spark, sf, documents, texts):
    out = queries.queries()["op2_mixing"](spark, sf).join(documents.select("doc_id", "source"), "doc_id").toPandas()
    assert len(out) == len(texts)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    assert all(words[i] == n for i, n in zip(out.doc_id, out["size"])) and (out.taken <= 2 * out["size"]).all()
    want = fill(out.groupby("source")["size"].sum().to_dict())
    for source, g in out.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[source]) and abs(g.taken.sum() - want[source]) <= 1
    again = queries.queries()["op2_mixing"](spark, sf).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == out.sort_values("doc_id").taken.tolist()


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([("a", 1, 13), ("b", 1, 40), (None, 1, 1), ("b", 2, 9)], "source string, pass int, quota long")
    out = mixing.splitting_tree(spark, quotas, 3, 5).toPandas()
    assert out.groupby(out.source.fillna("-") + out["pass"].astype(str)).taken.sum().to_dict() == {"a1": 13, "b1": 40, "-1": 1, "b2": 9}
    per = out.groupby("shard").taken.sum()
    assert per.max() - per.min() <= 1 and len(per) == 8


def test_hypergeometric_draw(spark):
    u = spark.range(2000).select((F.col("id") + 0.5).alias("u") / 2000)
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    x = u.select(mixing._hypergeometric(F.col("u"), F.lit(30), F.lit(100), F.lit(40)).alias("x")).toPandas().x
    assert abs(x.mean() - 12) < 0.02 and abs(x.var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.1


def test_mixing_odd(odd, nothing):
    out = mixing.draws(odd).collect()
    assert len(out) == odd.count()
    assert all(not r.draws for r in out if r["size"] == 0)
    back = mixing.mixed(odd.withColumn("mix_shard", F.lit("clash")))
    assert back.columns == [*odd.columns, "mix_shard", "mix_position"]
    assert mixing.draws(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# URLs

def test_url_parts():
    assert urls.parts("HTTP://Foo.COM:80/A/b?x#y") == ("foo.com:80", "/A/b")
    assert urls.parts("a://b?c/d") == ("b", "") and urls.parts("a://b#/x?y") == ("b", "")
    assert urls.parts(None) == urls.parts("no scheme") == ("", "") and urls.parts("://x") == ("x", "")


def test_url_rules(spark):
    cases = {
        "http://x.example.com/en/7b": ("example.com/en/7", "allow"), "http://example.com/en/8": ("com/en/", "block"), "http://notexample.com/en/7": ("com/en/", "block"),
        "http://a.example.net/de/8/": ("example.net/de/8", "block"), "http://q.net/de/8": ("net/de/", "allow"), "http://q.org/es/": ("org/es/", "block"), "http://q.org/es": (None, "allow"),
        "http://spam-farm.example.org/fr/1": (None, "block"), "http://com/en/": ("com/en/", "block"), "http://a.com/EN/": (None, "allow"), "http://a.de/x/cart": (None, "block"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*cases, None, "", "nothing"])], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = {r.url: (r.rule, r.verdict) for r in urls.judge(pages).collect()}
    for url, want in cases.items():
        assert got[url] == want, url
    assert got[None] == got[""] == got["nothing"] == (None, "allow")
    assert urls.judge(pages.where("false")).count() == 0


def test_url_patterns_are_indexed():
    index = urls.Index(urls.PATTERNS, {})
    assert not index.always
    for url in ("http://xxx.a/b", "http://a-porn.b/", "http://a.b/login", "http://a.b/c/signin.html", "http://a.b/c.exe", "http://a.b/c/d.x.zip", "http://a.b/.iso", "http://a.b/cart", "http://axxx.b/", "http://a.b/logins", "http://a.b/c.exes", "http://a.b/LOGIN"):
        where = "".join(urls.parts(url))
        want = sorted(p.name for p in urls.PATTERNS if re.search(p.pattern, where))[:1]
        assert index.judge(*urls.parts(url))[2] == (want[0] if want else None), url


# near-duplicates

def brute_components(texts: dict, width: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)):
                k = len(x & y)
                if 100 * k >= 80 * (len(x) + len(y) - k):
                    p, q = find(ids[a]), find(ids[b])
                    up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies() -> dict:
    """Copies of texts with words changed: hubs, chains, exact copies, short ones."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = {}
    for length in (3, 5, 8, 20, 60, 200):
        base = [word() for _ in range(length)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, length // 12))):
                copy[rng.randrange(length)] = word()
            out[len(out)] = " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)
        for _ in range(10):  # a chain
            base = list(base)
            base[rng.randrange(length)] = word()
            out[len(out)] = " ".join(base)
    return out


@pytest.mark.parametrize(("width", "chunk"), [(2, 10**6), (5, 10**6), (2, 300)])
def test_dedup(spark, monkeypatch, width, chunk):
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    made = near_copies()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in made.items()], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs, width=width).collect()}
    want = brute_components(made, width)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert got == want


def test_dedup_query(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.queries()["op4_minhash"](spark, sf).collect()}
    assert got == brute_components(texts, 2)


def test_dedup_odd(odd, nothing):
    out = dedup.near_duplicates(odd).toPandas()
    assert len(out) == odd.count() and out.kept.all()
    assert out[out.doc_id.isna()].component_id.isna().all() and (out[out.doc_id == 2].n_shingles == 0).all()
    assert dedup.near_duplicates(nothing).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 200)}


# PII

@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.binary(min_size=1, max_size=8))
def test_permutation(size, key):
    p = pii.Permutation(key, "t", size)
    out = [p(i) for i in range(size)]
    assert sorted(out) == list(range(size)) and all(a != b for a, b in enumerate(out))


def test_pii_formats():
    key = b"k"
    for number in ("4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"):
        new = pii.card(number, key)
        digits = re.sub(r"\D", "", new)
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", number) and pii.luhn_digit(digits[:-1]) == digits[-1] and new != number
    assert pii.card("4111111111111112", key) is None
    assert re.sub(r"\D", "", pii.card("4111-1111-1111-1111", key)) == re.sub(r"\D", "", pii.card("4111111111111111", key))
    new = pii.iban("DE89 3704 0044 0532 0130 00", key).replace(" ", "")
    assert pii._mod97(new[4:] + new[:4]) == 1 and new[:2] == "DE" and pii.iban("DE88370400440532013000", key) is None
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", pii.ssn("123-45-6789", key)) and pii.ssn("666-45-6789", key) is None
    assert re.fullmatch(r"\d\d\.\d\d\.\d{4}", pii.date("29.02.2024", key)) and pii.date("30.02.2024", key) is None
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", pii.phone("+1 (555) 010-2345", key))
    assert pii.email("Ann.Lee7@Mail.example.com", key).endswith("@Mail.example.com") and pii.ipv4("1.2.3.400", key) is None


def test_pii_documents(spark, odd, nothing):
    text = "mail ann@x.org, call +1 (212) 555-0199 or pay 4111111111111111 from 10.1.2.3 on 2024-05-06. ann@x.org"
    docs = spark.createDataFrame([(1, text), (2, "again ann@x.org")], "doc_id long, text string").withColumn("pii", F.lit("clash"))
    a, b = (r for r in pii.pseudonymise(docs, b"key").orderBy("doc_id").collect())
    for secret in ("ann@", "212) 555-0199", "4111111111111111", "10.1.2.3", "2024-05-06"):
        assert secret not in a.text
    assert len(set(re.findall(r"\S+@x\.org", a.text + " " + b.text))) == 1 and [p.kind for p in a.pii] == ["email", "phone", "card", "ipv4", "date", "email"]
    assert all(text[p.start : p.end] for p in a.pii)
    out = {r.doc_id: r.text for r in pii.pseudonymise(odd, b"key").collect()}
    assert out[1] is None and out[2] == "" and out[6] == "12345 !!! ???"
    assert pii.pseudonymise(nothing, b"key").count() == 0


def test_pii_after_a_failed_match():
    """What an over-matching pattern leaves after its check fails is searched again."""
    kinds = lambda t: [(k, t[s:e]) for s, e, k, _ in pii.replacements(t, b"k")]
    assert kinds("on 2023-05-01 2023-06-01 x") == [("date", "2023-05-01"), ("date", "2023-06-01")]
    assert kinds("123-45-6789 987-65-4321") == [("ssn", "123-45-6789")]  # area 987 isn't given out
    assert kinds("123-45-6789 887-65-4321") == [("ssn", "123-45-6789"), ("ssn", "887-65-4321")]
    assert kinds("row 7 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]
    assert kinds("4111 1111 1111 1111 7 rows") == [("card", "4111 1111 1111 1111")]
    assert kinds("4111 1111 1111 1111 5500 0000 0000 0004") == [("card", "4111 1111 1111 1111"), ("card", "5500 0000 0000 0004")]
    assert kinds("PAY DE89370400440532013000 AND THEN GO") == [("iban", "DE89370400440532013000")]
    assert kinds("PAY DE89 3704 0044 0532 0130 00 AND 2024-05-06") == [("iban", "DE89 3704 0044 0532 0130 00"), ("date", "2024-05-06")]
    assert kinds("DE89370400440532013000 A1@x.org") == [("iban", "DE89370400440532013000"), ("email", "A1@x.org")]
    for day in range(1, 29):  # whatever the digits of the two make as a card
        text = f"2023-05-{day:02d} 2023-06-{day:02d}"
        assert kinds(text) == [("date", text[:10]), ("date", text[11:])]


# quality

def brute_statistics(t: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if line in seen and re.search(r"[^\x20\x09-\x0D]", line):
            dup += 1
        seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é#|\n \t\x1c\x85"), max_size=80))
def test_quality_statistics(text):
    assert quality.statistics(text.encode()) == brute_statistics(text)


def test_quality_query(spark, sf, texts):
    out = queries.queries()["op6_quality"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    for r in out.itertuples():
        want = brute_statistics(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    out = out.set_index("doc_id").join(labels, how="inner")
    good = out[~out.base_failed]
    assert good[good.quality == 1].kept.mean() > 0.95 and good[good.quality == 0].kept.mean() < 0.2


def test_mcd(spark):
    rng = np.random.default_rng(1)
    clean, far = rng.normal(0, 1, (900, 4)) @ np.diag([1, 2, 0.5, 1]), rng.normal(8, 0.5, (180, 4))
    points = spark.createDataFrame(pd.DataFrame(np.vstack([clean, far]), columns=[f"x{i}" for i in range(4)]).assign(g="a"))
    est = quality.estimates(points).first()
    assert np.abs(np.array(est.mean)).max() < 0.25
    inverse = np.zeros((4, 4))
    for (i, j), x in zip(quality._PAIRS, est.inverse):
        inverse[i, j] = inverse[j, i] = x / est.scale
    d = lambda x: np.einsum("ni,ij,nj->n", x - est.mean, inverse, x - est.mean)
    assert d(far).min() > 3 * np.quantile(d(clean), 0.99)


def test_quality_odd(odd, nothing):
    out = quality.judge(odd).toPandas()
    assert len(out) == odd.count() and not out[out.base_failed].kept.any() and (out[out.doc_id == 1].n_words == 0).all()
    assert quality.judge(nothing).count() == 0


# language model

def test_lm_query(spark, sf, texts):
    got = queries.queries()["op7_ngram_lm"](spark, sf).toPandas().set_index("doc_id")
    docs = {i: (t or "").encode().lower().split() + ["</s>"] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in docs}
    c = Counter(w for i, d in docs.items() if fold[i] != 2 for w in d)
    n, v = sum(c.values()), len(c)
    for i, d in docs.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(d), sum(c[w] > 0 for w in d), n, fold[i] == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d))
    # the interpolated score, from plain counts and the weights learned from plain counts
    pair = lambda keep: Counter((a, b) for i, d in docs.items() if keep(fold[i]) for a, b in zip(["<s>"] + d, d))
    full, kept, held = pair(lambda f: f != 2), pair(lambda f: f not in (2, 3)), pair(lambda f: f == 3)
    def parts(counts):
        uni, ctx = Counter(), Counter()
        for (a, b), k in counts.items():
            uni[b] += k
            ctx[a] += k
        return uni, ctx, sum(uni.values())
    uni, ctx, total = parts(kept)
    cells = Counter()
    for (a, b), k in held.items():
        p2, p1 = (kept[a, b] / ctx[a] if ctx[a] else 0), uni[b] / total
        step = lambda p: round(ngram_lm.STEPS * math.log2(p)) if p else 1
        cells[min(int(math.log2(ctx[a] + 1)), ngram_lm.BUCKETS - 1), step(p2), step(p1)] += k
    weights = ngram_lm.learn_weights(np.array([(*x, k) for x, k in cells.items()]), 1 / (v + 1))
    uni, ctx, total = parts(full)
    for i in sorted(docs)[:40]:
        s = 0.0
        for a, b in zip(["<s>"] + docs[i], docs[i]):
            w = weights[min(int(math.log2(ctx[a] + 1)), ngram_lm.BUCKETS - 1)]
            s += math.log10(w[0] * (full[a, b] / ctx[a] if ctx[a] else 0) + w[1] * uni[b] / total + w[2] / (v + 1))
        assert got.loc[i].score == pytest.approx(s, rel=1e-6)


def test_lm_blocks_dont_matter(spark, documents, monkeypatch):
    fold = F.pmod(F.col("doc_id"), F.lit(7))
    one = ngram_lm.score(documents, fold != 2, fold == 3).toPandas().sort_values("doc_id").score.to_numpy()
    monkeypatch.setattr(ngram_lm, "BLOCK", 40_000)
    many = ngram_lm.score(documents.repartition(3, "doc_id").coalesce(3), fold != 2, fold == 3).toPandas().sort_values("doc_id").score.to_numpy()
    np.testing.assert_allclose(one, many, rtol=1e-4)


def test_lm_block_names():
    """Blocks whose rows differ only late in their texts have names of their own."""
    name = lambda t: next(ngram_lm._blocks([pa.RecordBatch.from_pydict({"id": pa.array([None], pa.int64()), "weight": [1], "held": [False], "text": [t]})], pa.int64(), ngram_lm.BLOCK))[0]
    start = "the same opening words " * 4
    assert name(start + "one") == name(start + "one") != name(start + "two")


def test_lm_repeated_and_null_ids(spark):
    """Rows that share id, length and opening, over several partitions, against plain counts; any size of blocks."""
    start = "the same opening words of a template " * 3
    texts = [start + x for x in ("aaa bbb", "ccc ddd", "aaa ddd", "eee")] * 3 + [start + "aaa bbb"] * 2
    rows = [(None if i % 3 else 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(5).cache()
    c = Counter(w for t in texts for w in [*t.split(), "</s>"])
    n, v = sum(c.values()), len(c)
    want = sorted(round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t.split(), "</s>"]), 9) for t in texts)
    for size in (None, 200, 1 << 20):
        out = ngram_lm.score(docs, F.lit(True), F.length("text") % 2 == 0, block_bytes=size).toPandas()
        assert sorted(round(x, 9) for x in out.base_score) == want and (out.n_known == out.n_tokens).all() and out.doc_id.isna().sum() == sum(r[0] is None for r in rows)


def test_lm_weights():
    cells = np.array([(3, 0, -8, 90), (3, 1, -8, 10), (5, 1, 1, 50)])
    w = ngram_lm.learn_weights(cells, 1e-4)
    assert w[3, 0] > 0.85 and w[5, 2] > 0.95 and np.allclose(w.sum(1), 1)


def test_lm_odd(odd, nothing):
    fold = F.coalesce(F.col("doc_id") % 3, F.lit(0))
    out = ngram_lm.score(odd, fold != 2, fold == 1).toPandas()
    assert len(out) == odd.count() and np.isfinite(out.score).all() and (out[out.doc_id == 1].n_tokens == 1).all()
    assert np.isfinite(ngram_lm.score(odd, F.lit(False), F.lit(False)).toPandas().score).all()
    assert ngram_lm.score(nothing, F.lit(True), F.lit(False)).count() == 0


# secrets

def plain_spans(t: str) -> list:
    found = []
    for kind, (pattern, flags, least) in enumerate(((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))):
        for m in re.finditer(pattern, t, flags):
            if len(m[2] if kind == 0 else m[0]) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "ToKen", "api_key", "apikey", "=", ": ", '"', "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "x", " ", "é", "ſecret", "."]), max_size=14))
def test_base_spans(parts):
    assert secrets.base_spans("".join(parts)) == plain_spans("".join(parts))


def test_automaton():
    rng = random.Random(2)
    make = lambda: "KEY-" + "".join(rng.choice("0123456789ABCDEF") for _ in range(16))
    a = secrets.Automaton(Counter(make() for _ in range(200)))
    assert len(a.states) < 30 and a.bits(make()) < 90 and a.bits("KEY-zzzzzzzzzzzzzzzz") == a.bits("plain-words-here-too") == math.inf
    total = secrets.Automaton({"a": 3, "ab": 1})
    assert sum(2 ** -total.bits(s) for s in ("a", "ab")) == pytest.approx(1) or len(total.states) < 3


def test_secrets_query(spark, sf, texts):
    for r in queries.queries()["op8_secrets"](spark, sf).collect():
        want = plain_spans(texts[r.doc_id] or "")
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))


def test_format_secrets(spark):
    rng = random.Random(3)
    token = lambda: "tk" + "".join(rng.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(22))
    docs = spark.createDataFrame([(i, f"plain words about things and {'token=' + token() if i % 2 else 'nothing of note'} here") for i in range(300)], "doc_id long, text string")
    scanner = secrets.fit(docs)
    hidden = token()
    assert [(k, "x " + hidden + " y") for _, k, _ in scanner.scan("x " + hidden + " y")] and not scanner.scan("a perfectly-ordinary.hyphenated-word-of-2024 here")


def test_format_secrets_short_and_glued():
    rng = random.Random(5)
    make = lambda first, n: first + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(n))
    scanner = secrets.Scanner({"long": Counter(make("Q7", 22) for _ in range(200)), "short": Counter(make("Z9", 8) for _ in range(200))}, secrets.pairs_of("plain words about things and nothing of note on 2024-05-06 " * 50))
    found = lambda t: [t[s:e] for s, k, e in scanner.scan(t) if k == len(secrets.KINDS)]
    long, other, short = make("Q7", 22), make("Q7", 22), make("Z9", 8)
    assert found(f"a {short} b") == [short]
    for text in (f"see {long}.", f"GH={long}", f"path/{long}", f"x=1/{long}/etc", f"{long}==", f"{long}--", f"use {long}.Then"):
        assert found(text) == [long], text
    assert found(f"{long}/{other}") == [long, other] and found(f"k={short}={long}.") == [short, long]
    assert found("plain/words=and.things 2024-05-06 nothing.of/note") == []


def test_secrets_odd(odd, nothing):
    scanner = secrets.fit(odd)
    assert secrets.scan(odd.withColumn("secret_spans", F.lit("clash")), scanner).count() == odd.count()
    assert secrets.redact(odd, scanner).columns == odd.columns
    assert secrets.scan(nothing, secrets.fit(nothing)).count() == 0


# embeddings

def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(5)
    rows = []
    for group in range(6):
        base = rng.standard_normal(64)
        for k in range(30):
            v = base + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((len(rows), (v * (k + 1)).astype(np.float32).tolist(), group % 3))
    rows += [(len(rows) + i, v, lab) for i, (v, lab) in enumerate([(None, 1), ([0.0] * 64, 1), ([math.nan] * 64, 1), ([1.0, None], 1), ([1.0] * 64, None), ([1.0] * 64, None), ([], 1), ([1.0] * 3, 1), ([2.0] * 3, 1), ([2.0] * 3, 1)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cells", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, x, l1), (j, y, l2) = ok[a], ok[b]
            if l1 == l2 and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    assert sum(links.values()) > 500
    assert got == {i: (links[i], find(i)) for i in links}
    assert embeddings.near_duplicates(df.where("false")).count() == 0


# pipeline

def test_pipeline(spark, sf, documents):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == documents.columns, name
        after = after.cache()
        if name == "near_duplicates":
            want = brute_components({r.doc_id: r.text for r in docs.collect()}, 5)
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, root) in want.items() if root == i)
        if name == "secrets":
            assert not any(plain_spans(r.text) for r in after.collect() if "[SECRET]" not in r.text) and after.count() == docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and json.dumps(last.columns)
