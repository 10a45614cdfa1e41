"""URL filters (operator 3): rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens (runs of a-z, 0-9) that any URL it matches must
hold as whole tokens. Of these the token that the fewest URLs hold indexes the rule. A URL's tokens fetch
its candidate rules, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import common

_token = re.compile(r"[a-z0-9]+").findall
_A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host (after the first :// up to / ? # or the end, A-Z lower-cased) and path (from there up to ? # or the end)."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    end = min(ends, default=len(rest))
    path = re.split(r"[?#]", rest[end:], maxsplit=1)[0]
    return rest[:end].translate(_A_TO_Z), path


@dataclass(frozen=True)
class Rule:
    """verdict: block or allow. name: shown for the rule. pattern: searched in host + path, lower-cased by A-Z in the host only.

    tokens: literal tokens that a match needs. Rules with listed=True are a site list's: of those that
    match the longest wins; other rules are general patterns and decide where no listed one matches.
    any_of: where a match needs no token of all, tokens of which it needs one.
    """

    verdict: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False
    length: int = 0
    any_of: tuple[str, ...] = ()


def site_rule(verdict: str, rule: str) -> Rule:
    """A listed rule host/path: fits the host and its subdomains if the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    # the last token of the path may go on in the url, and then isn't a whole token there
    needed = _token(host) + (_token(path.lower()) if path.endswith("/") else _token(path.lower())[:-1])
    return Rule(verdict, rule, rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(needed), True, len(rule))


#: The site list of the query contract.
SITE_LIST = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: General patterns: what a crawl doesn't want, by host or path. Fixed values.
PATTERNS = (
    Rule("block", "spam host", r"\A(?:[^/]*[.-])?spam[.-]", ("spam",)),
    Rule("block", "casino host", r"\A(?:[^/]*[.-])?casino[.-]", ("casino",)),
    Rule("block", "adult host", r"\A(?:[^/]*[.-])?(?:xxx|porn)[.-]", (), any_of=("xxx", "porn")),
    Rule("block", "login page", r"/(?:login|signin)(?:/|\.html|\Z)", (), any_of=("login", "signin")),
    Rule("block", "shopping cart", r"/cart(?:/|\.html|\Z)", ("cart",)),
    Rule("block", "binary download", r"\.(?:exe|zip|iso)\Z", (), any_of=("exe", "zip", "iso")),
)


class Index:
    """Rules by their rarest token, or by each of those that a match needs one of. Rules without a token are candidates for every URL.

    Memory: the rules, which are the caller's parameter and don't grow with the URLs.
    """

    def __init__(self, rules, frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        used: Counter = Counter()
        for rule in rules:
            compiled = (rule, re.compile(rule.pattern))
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (frequency.get(t, 0), used[t], t))
                used[rarest] += 1
                self.by_token.setdefault(rarest, []).append(compiled)
            elif rule.any_of:
                for token in rule.any_of:
                    self.by_token.setdefault(token, []).append(compiled)
            else:
                self.always.append(compiled)

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """The listed rule that decides, the verdict, and the general pattern that decided in its stead."""
        where = host + path
        best = pattern = None
        found = list(self.always)
        for token in dict.fromkeys(_token(where.lower())):
            found += self.by_token.get(token, ())
        for rule, compiled in found:
            if compiled.search(where):
                if rule.listed and (best is None or (rule.length, rule.name) > (best.length, best.name)):
                    best = rule
                elif not rule.listed and (pattern is None or (rule.verdict != "allow", rule.name) < (pattern.verdict != "allow", pattern.name)):
                    pattern = rule
        if best:
            return best.name, best.verdict, None
        return (None, pattern.verdict, pattern.name) if pattern else (None, "allow", None)


class _Lazy:
    """Rules and frequencies on their way to a worker, whose index is made there, once for all of a broadcast's tasks."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.rules, self.frequency, self._made = rules, frequency, None

    def index(self) -> Index:
        if self._made is None:
            self._made = Index(self.rules, self.frequency)
        return self._made


def read_rules(spark: SparkSession, path: str, most: int = 1_000_000) -> list[Rule]:
    """Rules of a text file, one to a line, tab-separated: `site`, verdict and host/path; or `pattern`, verdict, name, regular
    expression, tokens that a match needs all of, and tokens of which it needs one (both separated by commas, either may be empty).

    Empty lines and those from # on count as none. A line of another form, and more than most lines, raise.
    """
    rows = spark.read.text(path).where("value <> '' and not value like '#%'").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    out = []
    for (line,) in rows:
        kind, verdict, *rest = line.split("\t")
        if verdict not in ("block", "allow") or (kind, len(rest)) not in (("site", 1), ("pattern", 2), ("pattern", 3), ("pattern", 4)):
            raise ValueError(f"no rule: {line!r}")
        if kind == "site":
            out.append(site_rule(verdict, rest[0]))
        else:
            needed, any_of = (tuple(filter(None, x.split(","))) for x in [*rest[2:], "", ""][:2])
            out.append(Rule(verdict, rest[0], rest[1], needed, any_of=any_of))
    return out


def split_url(url: Column) -> list[Column]:
    """host and path as parts() has them, as expressions."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower()).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path")]


def token_frequency(urls: DataFrame, url: str, rules) -> dict[str, int]:
    """In how many rows each token of the rules occurs: counted over all rows, as many results as the rules have tokens."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return {}
    tokens = F.filter(F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+")), lambda t: t.isin(wanted))
    return {r["token"]: r["n"] for r in urls.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


FIELDS = [T.StructField("host", T.StringType(), False), T.StructField("path", T.StringType(), False), T.StructField("rule", T.StringType(), True), T.StructField("verdict", T.StringType(), False), T.StructField("pattern", T.StringType(), True)]


def judge(pages: DataFrame, rules=None, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and pattern (the general rule that decided, if one did).

    Of listed rules that fit the longest decides (equal lengths: the last by name); else an allowing
    general pattern, else a blocking one, else the URL is allowed. Null URLs and those without :// have
    empty host and path, match nothing and are allowed. Narrow but for the token counts. Repeated rows
    stay; columns of these names are replaced. rules: Rules, e.g. read_rules(); by default SITE_LIST and PATTERNS.
    """
    rules = [*(site_rule(v, r) for v, r in SITE_LIST), *PATTERNS] if rules is None else list(rules)
    shared = pages.sparkSession.sparkContext.broadcast(_Lazy(rules, token_frequency(pages, url, rules)))  # the caller's rules
    taken = {f.name for f in FIELDS}
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in taken]
    split = pages.select(*[F.col(c) for c in kept], *split_url(F.col(url)))

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        index = shared.value.index()
        judged = [index.judge(h, p) for h, p in zip(common.texts_of(part, "host"), common.texts_of(part, "path"), strict=True)]
        return [pa.array([j[k] for j in judged], pa.string()) for k in range(3)]

    return common.add_columns(split, FIELDS[2:], compute, "path", [*kept, "host", "path"])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the site list and the general patterns. Null, empty and repeated urls: as judge() says."""
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])


def op3_sql() -> str:
    """The same in SQL: the site list as rows, every general pattern tried."""
    rows = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in SITE_LIST)
    patterns = " ".join(f"WHEN regexp_matches(host || path, '{p.pattern.replace(chr(92) + 'Z', chr(92) + 'z')}') THEN '{p.name}'" for p in sorted(PATTERNS, key=lambda p: p.name))
    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
lowered AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
rules(verdict, rule, rule_host, rule_path) AS (VALUES {rows}),
fits AS (SELECT DISTINCT host, path, verdict, rule FROM (SELECT DISTINCT host, path FROM lowered) l JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT host, path, verdict, rule FROM fits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) = 1),
other AS (SELECT page_id, host, path, CASE {patterns} END AS pattern FROM lowered)
SELECT page_id, o.host, o.path, rule, coalesce(b.verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM other o LEFT JOIN best b ON o.host = b.host AND o.path = b.path
"""
