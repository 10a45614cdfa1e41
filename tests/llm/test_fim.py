"""Operator 11 against a plain reading and its SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.llm import fim


def plain(id_, text, seed=1, plain_percent=10, spm_percent=20):
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in fim.MARKS) or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


ODD = [None, "", "a", "ab", "\x1e", "\x1f", "\x1e\x1f", "\x1fe\x1fd\x1ee", "\x1f\x1f\x1e\x1e" * 5, "𝔘𝔫𝔦", "éé‍👩‍👩‍👧", "line\nline\r\n\n", "\0\0", "<P", "<P>", "a<S>b", "<M>", "<<", "P>S>M>", "$0 \\1 $", "日本語テキスト" * 50, "x" * 200_000, "é\x1e" * 5000]


@pytest.mark.parametrize("percents", [(10, 20), (0, 50), (100, 0)])
def test_against_plain(spark, percents):
    rows = [(i * 100 + j, t) for j in range(12) for i, t in enumerate(ODD)] + [(None, "no id"), (None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.transform(docs, plain_percent=percents[0], spm_percent=percents[1]).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    found = sorted(((r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in made.collect()), key=repr)
    assert found == sorted(((i, t, plain(i, t, 1, *percents), t or "") for i, t in rows), key=repr)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", 5, "mine", "kept", "z")], "doc_id long, text string, N int, form string, __fim_n string, `a.b` string")
    row = fim.transform(docs).first()
    assert row["__fim_n"] == "kept" and row["a.b"] == "z" and row["n"] == 3 and row["output"] == plain(1, "abc")[4]
    assert fim.transform(docs.limit(0)).count() == 0
    other = fim.transform(docs.withColumnRenamed("text", "body"), text="body", names=("c", "shape", "p", "m", "o"))
    assert other.columns == ["doc_id", "body", "N", "form", "__fim_n", "a.b", "c", "shape", "p", "m", "o"]


def test_no_python_no_shuffle(spark, sf):
    plan = fim.op11_fim(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = sorted(tuple(r[c] for c in columns) for r in fim.op11_fim(spark, sf).collect())
    want = sorted(c.sql(f"select {', '.join(columns)} from ({fim.op11_sql()})").fetchall())
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
