"""Glob joins against a test of every pair."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from docsieve.functions import globs
from docsieve.operators import buckets

PATTERNS = ["/a*", "/*x", "/?b*", "**/foo*", "/*", "/**", "/*/*", "/?", "/??/*", "/[ab]*", "/[!a]", "/{ab,b}*", "/{a,b/c}", "/a**c", "/**/*b", "*", "**",
            "/\\*x", "/a.b*", "/*..*", "/a/b", "/a/*", "/*/fr/*", "/[/", "/{", "/é*", "/***a", "", "a*", "/[]*", "/a\\", "/*ab*ab*", "/a\\b/*", "/*/\\fr/c", "/[!a]/fr/*", "/{a/b,c}/fr", "/*/{fr,c}/*"]


def _brute(paths, patterns):
    return Counter(
        (key, text, number)
        for key, path in paths
        for number, text in patterns
        if path is not None and text is not None and (path == text or re.match(globs.path_glob_regex(text), path))
    )


@pytest.mark.parametrize("in_place", [256, 1])
def test_every_pair_is_found(spark, monkeypatch, in_place):
    monkeypatch.setattr(buckets, "_IN_PLACE", in_place)
    draw = random.Random(5)
    paths = ["/" + "".join(draw.choice("abcx/fo.r") for _ in range(draw.randint(0, 7))) for _ in range(150)]
    paths += ["/foo", "/x/foo", "/x/y/foobar", "/b/c", "/é", "/éa", "/ab", "", "a", "/a/fr/c", "///fr/c", "/a/b/fr", "/ab/x", "/a\\b/x", "/ab-ab", None, *[text for text in PATTERNS if text], "/ab", "/ab"]
    rows = list(enumerate(paths))
    listed = list(enumerate([*PATTERNS, None, "/a*", "/**"]))  # some twice
    left = spark.createDataFrame(rows, "id long, path string")
    right = spark.createDataFrame(listed, "number long, pattern string")
    found = Counter((r["id"], r["pattern"], r["number"]) for r in buckets.glob_join(left, "path", right, "pattern").collect())
    want = _brute(rows, listed)
    assert found - want == Counter() and want - found == Counter()


def test_many_patterns_without_a_folder_are_looked_up(spark):
    texts = [f"/{a}{b}{c}*" for a in "abcdefghij" for b in "abcdefghij" for c in "0123456789"]
    right = spark.createDataFrame([(text,) for text in texts], "pattern string")
    left = spark.createDataFrame([(f"/{a}{b}{c}/x",) for a in "abc" for b in "xyab" for c in "012"], "path string")
    joined = buckets.glob_join(left, "path", right, "pattern")
    assert joined.count() == 0  # * stops at the slash
    right = right.selectExpr("concat(pattern, '/?') AS pattern")
    joined = buckets.glob_join(left, "path", right, "pattern")
    assert sorted(r["path"] for r in joined.collect()) == sorted(f"/{a}{b}{c}/x" for a in "abc" for b in "ab" for c in "012")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_patterns_and_no_paths(spark):
    paths = spark.createDataFrame([("/a",)], "path string")
    patterns = spark.createDataFrame([("/a*",), ("/**",)], "pattern string")
    assert buckets.glob_join(paths, "path", patterns.limit(0), "pattern").count() == 0
    assert buckets.glob_join(paths.limit(0), "path", patterns, "pattern").count() == 0
