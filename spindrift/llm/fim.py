"""Fill-in-the-middle transformation (operator 11) by escaped marker injection, in column expressions only.

A delimiter that the text can't hold any more after escaping is put behind each unit (code point). Counting it gives the
number of units, substring_index cuts at any rank, and removing it and the escapes gives the parts back:

1. escape: the escape character becomes escape + `e`, the delimiter escape + `d`;
2. inject: regexp_replace puts the delimiter behind each escape pair and each other code point;
3. cut: substring_index by rank, from the left for the prefix, from the right for middle and suffix;
4. unescape the parts and put them together behind the marks.

Narrow: no shuffle, no Python. A text takes about twice its size in memory while its row is worked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import common

#: Delimiter and escape: control characters, rare in text, so that few texts grow by escaping.
_CUT, _ESCAPE = "\x1e", "\x1f"
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def injected(text: Column) -> Column:
    """The text with the delimiter behind each of its code points; delimiters and escapes of its own are escaped."""
    escaped = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_CUT), F.lit(_ESCAPE + "d"))
    return F.regexp_replace(escaped, F.lit(f"(?s){_ESCAPE}.|[^{_ESCAPE}]"), F.lit(f"$0{_CUT}"))


def units(marked: Column) -> Column:
    """How many units an injected text has."""
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(_CUT), F.lit("")))).cast("long")


def _plain(part: Column) -> Column:
    """Without delimiters and escapes."""
    bare = F.replace(part, F.lit(_CUT), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "d"), F.lit(_CUT)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def _ranked(marked: Column, count: Column) -> Column:
    """The first count units, or where it is negative what stands behind the delimiter of that rank from the right."""
    return F.call_function("substring_index", marked, F.lit(_CUT), count.cast("int"))


def draws(id: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: groups of 8 digits of the hex SHA-256 of seed, a colon and the id (none: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, names: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """docs with n (code points), form (`psm`, `spm`, `plain`), prefix_chars and middle_chars (null if plain) and output.

    Two keyed ranks cut a text in prefix, middle and suffix, any of them may be empty. psm: prefix, suffix, middle behind
    their marks; spm: suffix, prefix, middle; plain: the text itself. plain_percent of the texts stay plain, as do
    empty ones and those that hold a mark; of the others spm_percent are spm. names are the new columns' names.

    Null text counts as empty; a null id is drawn for as an empty one. Repeated rows get equal results. Other columns of
    docs stay; one of a new column's name gives way. Texts of any length are cut as a whole, up to 2^31 - 1 bytes with delimiters.
    """
    taken = {n.lower() for n in names}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    own = [c.lower() for c in docs.columns]
    free = lambda name: name if name not in own else free("_" + name)
    marked, count, h, cuts = (free(f"__fim_{x}") for x in ("marked", "n", "h", "cuts"))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({marked: injected(whole), h: F.array(*draws(id, seed))}).withColumn(count, units(F.col(marked)))
    one, two = (F.col(h)[i] % (F.col(count) + 1) for i in range(2))
    rows = rows.withColumn(cuts, F.struct(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")))
    a, b, m = F.col(cuts)["a"], F.col(cuts)["b"], F.col(marked)
    held = F.lit(False)
    for mark in MARKS:
        held = held | F.contains(whole, F.lit(mark))
    form = F.when((F.col(count) == 0) | held | (F.col(h)[2] % 100 >= 100 - plain_percent), "plain").when(F.col(h)[3] % 100 < spm_percent, "spm").otherwise("psm")
    shaped = rows.withColumn(free("__fim_form"), form)
    form = F.col(free("__fim_form"))
    prefix = _plain(_ranked(m, a))
    middle = _plain(_ranked(_ranked(m, b), a - b))
    suffix = _plain(_ranked(m, b - F.col(count) - 1))
    p, s, x = (F.lit(mark) for mark in MARKS)
    output = F.when(form == "plain", whole).when(form == "psm", F.concat(p, prefix, s, suffix, x, middle)).otherwise(F.concat(s, suffix, p, prefix, x, middle))
    measured = lambda n: F.when(form != "plain", n)
    made = (F.col(count), form, measured(a), measured(b - a), output)
    return shaped.select(*kept, *[c.alias(n) for c, n in zip(made, names, strict=True)])


def restored(output: Column, form: Column) -> Column:
    """The text that transform() made output of. A text of a form other than plain holds no mark, and marks can't overlap."""
    p, s, x = MARKS
    skip = len(p) + 1
    cut = lambda part, mark: F.call_function("substring_index", part, F.lit(mark), F.lit(1))
    after = lambda part, mark: F.call_function("substring_index", part, F.lit(mark), F.lit(-1))
    body = F.substring(output, skip, 2**31 - 1)
    first, last = cut(body, x), after(body, x)  # all but the middle; the middle
    psm = F.concat(cut(first, s), last, after(first, s))
    spm = F.concat(after(first, p), last, cut(first, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents for filling in the middle; digests of the output and of the text rebuilt from it."""
    made = transform(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op11_sql() -> str:
    """The same by slices of the text; DuckDB has no injection to repeat."""
    return """
with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
h as (select *, cast('0x' || d[1:8] as ubigint)::bigint as h1, cast('0x' || d[9:16] as ubigint)::bigint as h2, cast('0x' || d[17:24] as ubigint)::bigint as h3, cast('0x' || d[25:32] as ubigint)::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(text, 1, a) as pre, substring(text, a + 1, b - a) as mid, substring(text, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256 from p"""
