"""A rule file of thousands of rules against trying every rule; odd and very long urls."""

import random
import re
import time

import pytest

from spindrift.llm import urls

ODD = [None, "", "://", "a://", "http://", "x://H?q", "x://H#f/y", "http://Ä.COM/Ö?x", "http://a\nb/c\nd?e", "no scheme/at all", "http://u:p@host:80//x//", "a://b://c/d", "http://ẞ.com/İ", "http://a.com/" + "x/" * 50_000]


def brute(rules, url):
    host, path = urls.parts(url)
    where = host + path
    listed = [r for r in rules if r.listed and (host == r.name.partition("/")[0] or host.endswith("." + r.name.partition("/")[0])) and path.startswith("/" + r.name.partition("/")[2])]
    if listed:
        best = max(listed, key=lambda r: (len(r.name), r.name))
        return best.name, best.verdict, None
    found = sorted((r.verdict != "allow", r.name, r.verdict) for r in rules if not r.listed and re.search(r.pattern, where))
    return (None, found[0][2], found[0][1]) if found else (None, "allow", None)


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 3)))
    lines = ["# a comment", ""]
    sites = {f"{'.'.join(word() for _ in range(rng.randint(1, 3)))}/{'/'.join(word() for _ in range(rng.randint(0, 2)))}" for _ in range(4000)}
    lines += [f"site\t{rng.choice(['block', 'allow'])}\t{s}" for s in sorted(sites)]
    tokens = sorted({word() for _ in range(1500)})
    lines += [f"pattern\t{rng.choice(['block', 'allow'])}\tp{t}\t(?:^|[^a-z0-9]){t}(?:[^a-z0-9]|$)\t{t}" for t in tokens]
    lines += ["pattern\tblock\teither\t[./](?:zzz|yyy)\\Z\t\tzzz,yyy"]
    path = tmp_path_factory.mktemp("rules") / "rules.txt"
    path.write_text("\n".join(lines))
    found = urls.read_rules(spark, str(path))
    assert len(found) == len(lines) - 2
    return found


def test_thousands_of_rules(spark, rules):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghyz", k=rng.randint(1, 3)))
    made = [f"http://{'.'.join(word() for _ in range(3))}/{'/'.join(word() for _ in range(3))}?{word()}" for _ in range(400)] + ODD + ["http://a.b/zzz", "http://a.b/c.yyy"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    assert len(got) == len(made)
    for i, u in enumerate(made):
        r = got[i]
        assert (r.host, r.path) == urls.parts(u), u
        assert (r.rule, r.verdict, r.pattern) == brute(rules, u), u


def test_rarest_token_indexes(rules):
    index = urls.Index(rules, {t: 1000 for t in ("a", "b", "c")})
    assert not index.always and sum(map(len, index.by_token.values())) >= len(rules)
    start = time.time()
    for k in range(3000):
        index.judge("x.y.z", f"/q{k}/w{k}")
    assert time.time() - start < 2  # urls without any rule's token run no expression


def test_bad_rules(spark, tmp_path):
    for line in ("site\tmaybe\ta/b", "site\tblock", "regex\tblock\ta\tb"):
        (tmp_path / "bad.txt").write_text(line)
        with pytest.raises(ValueError):
            urls.read_rules(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "many.txt").write_text("site\tblock\ta/b\n" * 5)
    with pytest.raises(ValueError):
        urls.read_rules(spark, str(tmp_path / "many.txt"), most=4)
