"""URL rules and sharding."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from docsieve.llm.sharding import numbered, permuted, radices, shards
from docsieve.llm.url_filters import PATTERNS, Rule, compiled, judged

RULES = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block")]
URLS = [
    None, "", "no scheme", "http://", "://x.org", "https://EXAMPLE.org/es/a", "https://a.example.org/en/12?x=/es/", "https://example.org", "https://notexample.org/es/1",
    "http://example.org/en/1", "http://example.org/EN/1", "http://b.com/de/#/fr/", "http://b.com/fr/?q", "http://com/de/x", "http://xcom/de/x", "http://m.casino-win.example.net/a",
    "http://casino-win.net", "http://mycasino-win.net/", "http://a.b/://c.org/", "http://é.org/é", "http://example.org:80/es/", "http://x.org/a\nb?c", "http://x.org/" + "a/" * 5000,
]


def expected(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in RULES if (host == (h := r.text.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.text.partition("/")[2])]
    won = max(fits, key=lambda r: len(r.text), default=None)
    junk = any(("." + host).find("." + p.text[2:]) >= 0 for p in PATTERNS)
    return host, path, won and won.text, won.action if won else "block" if junk else "allow"


def test_urls_against_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(5, URLS[5], "x", "y"), (None, URLS[9], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, token string")
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in judged(pages, RULES + list(PATTERNS) + RULES).collect())
    assert got == sorted((i is None, i or 0, *expected(u)) for i, u, _, _ in rows)


def test_urls_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert judged(pages.where("false"), RULES).count() == 0
    assert [(r["rule"], r["verdict"]) for r in judged(pages, [], default="block").collect()] == [(None, "block")]


def test_pattern_rules(spark):
    rules = [Rule("*/ads/*", "block", "pattern"), Rule("||tracker.^", "block", "pattern"), Rule("|good.org/ads/|", "allow", "pattern"), Rule("*xy*", "block", "pattern")]
    urls = {"http://a.org/ads/1": "block", "http://good.org/ads/": "allow", "http://good.org/ads/2": "block", "http://a.org/axyb": "block", "http://a.org/b": "allow", "http://Z.ORG/ADS/q": "block"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in judged(pages, rules).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())


def test_a_long_list_of_rules(spark):
    rules = [Rule(f"h{i}.net/", "block" if i % 3 else "allow") for i in range(50_000)] + [Rule(f"h{i}.net/deep/", "allow") for i in range(0, 50_000, 10)]
    rules += [Rule('say "x\\y"/', "block"), Rule("*zz*", "block", "pattern")]
    pages = spark.range(0, 60_000, 7).selectExpr("id page_id", "concat('http://www.h', id, '.net/', if(id % 2 = 0, 'deep/1', 'q')) url")
    table = judged(pages, rules)
    assert table._jdf.queryExecution().logical().toString().count("struct(") < 50  # the plan does not grow with the list
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in table.collect()}
    want = {}
    for i in range(0, 60_000, 7):
        deep = i % 10 == 0 and i % 2 == 0 and i < 50_000
        want[i] = (f"h{i}.net/deep/", "allow") if deep else (f"h{i}.net/", "block" if i % 3 else "allow") if i < 50_000 else (None, "allow")
    assert got == want


def test_tokens_are_whole_only():
    assert compiled(Rule("example.org/en/1", "block"))[1] == ["example", "org", "en"]
    assert compiled(Rule("*ads*", "block", "pattern"))[1] == []
    assert compiled(Rule("||ads-x.", "block", "pattern"))[1] == ["ads", "x"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 97, 1000, 4097])
def test_permutation(spark, n):
    a, b = radices(n)
    assert a >= b and n <= a * b < n + a
    for seed in (1, 99):
        got = [r[0] for r in spark.range(n).select(permuted("id", n, seed)).collect()]
        assert sorted(got) == list(range(n))
    assert n < 50 or got != sorted(got)


def test_large_domain_stays_in_range(spark):
    n = 10**12 + 7
    got = spark.range(2000).select((F.col("id") * 499_999_999).alias("i")).where(f"i < {n}").select(permuted("i", n).alias("p")).agg(F.min("p"), F.max("p"), F.count_distinct("p"), F.count("*")).first()
    assert 0 <= got[0] and got[1] < n and got[2] == got[3]


def test_shards(spark):
    rows = [(i, "text é %d" % (i % 7), "a", 1) for i in range(500)] + [(None, None, "a", 2), (3, "", "a", 3)] + [(9, "same", "a", 4)] * 300 + [(10, "x" * 100_000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    out = shards(docs, 8).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    sizes = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out)
    assert sizes == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    again = shards(docs.repartition(13), 8).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(out, key=key) == sorted(again, key=key)
    assert shards(docs.where("false")).count() == 0


def test_numbers_are_gapless(spark):
    rows = spark.range(5000).select((F.col("id") % 3000).alias("k"))
    got = sorted(r["row_number"] for r in numbered(rows, ["k"]).collect())
    assert got == list(range(5000))
