"""Globs, signatures, identifiers, JSON paths, permissions."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from docsieve.functions import globs, ids, paths
from docsieve.operators import buckets, security
from docsieve.sources.writers import table_format_of

# fixed values: published patterns and the paths they match and miss
PATTERNS = ["/easy_case", "/easy_case/suffix", "/wildcard_case/**", "/another/wild*card/case", "/final*"]
HITS = ["/easy_case", "/easy_case/suffix", "/wildcard_case/nested1/nested2", "/another/wildXXXcard/case", "/finally"]
MISSES = ["", "/easy_case/nonmatching", "/easy_case/suffix/more", "/wildcard_caseSUFFIX", "/another/wildXXXcare/case", "/final/nested"]


def names(spark, values, column="path"):
    return spark.createDataFrame([(value,) for value in values], f"{column} string")


def test_path_globs(spark):
    df = names(spark, HITS + MISSES)
    assert sorted(row["path"] for row in df.filter(globs.matches_path(F.col("path"), PATTERNS)).collect()) == sorted(HITS)
    assert buckets.matching_buckets(HITS + MISSES, PATTERNS) == sorted(HITS)


def test_glob_join_agrees_with_the_filter(spark):
    paths_df = names(spark, HITS + MISSES + ["/wildcard_case/a.b", "relative", "/x"])
    patterns = names(spark, PATTERNS + ["/**", "/?", "rel*", "/*/suffix", "/*/*/case", "/**/nested2", "*", "/*/a.?"], "pattern")
    found = {tuple(row) for row in buckets.glob_join(paths_df, "path", patterns, "pattern").collect()}
    import re

    expected = {
        (row["path"], pattern["pattern"])
        for row in paths_df.collect() for pattern in patterns.collect()
        if re.match(globs.path_glob_regex(pattern["pattern"]), row["path"])
    }
    assert found == expected and ("/wildcard_case/a.b", "/wildcard_case/**") in found
    expanded = buckets.expand_patterns(paths_df, "path", names(spark, PATTERNS, "pattern"), "pattern")
    assert sorted(row["path"] for row in expanded.collect()) == sorted(HITS + ["/wildcard_case/a.b"])


def test_simple_globs():
    assert globs.simple_glob_regex("a*") == "^a.*$"
    assert globs.simple_glob_regex("sdf?d\\f") == "^sdf.d\\\\f$"
    assert globs.simple_glob_regex("asdf.*") == "^asdf\\..*$"
    assert globs.pattern_regex("/www\\..*\\.com/i") == "(?i)www\\..*\\.com"


def test_rule_lists(spark):
    hosts = names(spark, ["web1", "web2", "db1"], "h")
    kept = lambda rules: sorted(row["h"] for row in hosts.filter(globs.rule_list(F.col("h"), rules)).collect())
    assert kept([]) == ["db1", "web1", "web2"]
    assert kept(["+WEB*"]) == ["web1", "web2"] and kept(["-web*"]) == ["db1"]
    assert kept(["web1", "/^db/"]) == ["db1", "web1"]


@pytest.mark.parametrize(
    "path,sub,expected",
    [
        ("/test+extra/", None, "test_extra__c1651d4c69ed"),
        ("/test+extra/", "test+;12345", "test_extra_test_12345__c1651d4c69ed"),
        ("/test+extra/4354____42", None, "test_extra_4354_42__bb8a6a382d7b"),
        ("test+extra/4354____42/some/more/COMPONENTS_VERY_VERY_LONG", None, "test_extra_more_components_very__7768508661fc"),
    ],
)
def test_signatures(spark, path, sub, expected):
    made = ids.bucket_signature(F.lit(path), None if sub is None else F.lit(sub))
    assert spark.range(1).select(made).first()[0] == expected


def test_uuids(spark):
    class Plain:
        bytes = b""

    row = spark.range(1).select(ids.name_uuid(F.lit("hello")).alias("n"), ids.time_uuid(F.lit(1445019566566)).alias("t")).first()
    import hashlib

    assert row["n"] == str(uuid.UUID(bytes=hashlib.md5(b"hello").digest(), version=3))
    assert uuid.UUID(row["t"]).version == 1
    real = str(uuid.uuid1())
    millis = (uuid.UUID(real).time - 0x01B21DD213814000) // 10000
    got = spark.range(1).select(ids.time_uuid_millis(F.lit(real)).alias("a"), ids.time_uuid_millis(F.lit(row["t"])).alias("b")).first()
    assert (got["a"], got["b"]) == (millis, 1445019566566)


def test_json_paths(spark):
    text = '{"a": {"aa": [ {"aaa":true}, {} ], "b": false, "n": null }}'
    row = spark.range(1).select(F.try_parse_json(F.lit(text)).alias("v"))
    got = row.select(*[paths.json_value_at(F.col("v"), path).alias(path.replace(".", "_")) for path in ("a.b", "a.aa.aaa", "a.b.c", "a.z", "z", "a.n")]).first()
    assert tuple(got) == ("false", "true", None, None, None, None)
    nested = spark.sql("SELECT named_struct('aa', array(named_struct('aaa', true)), 'b', false) AS a")
    assert nested.select(paths.value_at(nested.schema, "a.aa.aaa").alias("x"), paths.value_at(nested.schema, "a.b.c").alias("y")).first().asDict() == {"x": True, "y": None}


def test_fold(spark):
    text = F.lit('{"misc":true,"long":1,"string":""}')
    folded = paths.fold_into_json(text, {"long": (F.lit(10), "bigint"), "double": (F.lit(1.1), "double"), "string": (F.lit("val"), "string")})
    assert json.loads(spark.range(1).select(folded).first()[0]) == {"misc": True, "long": 10, "string": "val", "double": 1.1}
    texts = ['{"n": 5, "t": "5", "o": {"a": [1, null]}, "b": false}', None, "{}", "{bad", "[1]", "7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(paths.fold_into_json(F.col("t"), {"x": (F.lit(1), "bigint")}), paths.not_an_object(F.col("t"))).collect()
    assert json.loads(rows[0][0]) == {"n": 5, "t": "5", "o": {"a": [1, None]}, "b": False, "x": 1}
    assert [r[0] for r in rows[1:]] == ['{"x":1}', '{"x":1}', None, None, None] and [r[1] for r in rows] == [False, False, False, True, True, True]


def test_addresses(spark):
    df = names(spark, ["/b", "/b:", "/b:$start", "/b:x", "x"])
    got = [tuple(row["a"]) for row in df.select(ids.stage_address(F.col("path"), "/own").alias("a")).collect()]
    assert got == [("/b", "$end"), ("/b", "$start"), ("/b", "$start"), ("/b", "x"), ("/own", "x")]


def test_permissions(spark):
    df = names(spark, ["/a/b", "/a/b/c", "/a/x", "/z"])
    held = ["Bucket:read:a:b", "Bucket:*:z"]
    assert sorted(row["path"] for row in security.readable_rows(df, "path", held).collect()) == ["/a/b", "/a/b/c", "/z"]
    grants = spark.createDataFrame([("me", "Bucket:read:a:*"), ("you", "*")], "principal string, permission string")
    text = ids.permission("Bucket", "read", F.col("path"))
    assert sorted(row["path"] for row in security.authorized(df, text, grants, "me").collect()) == ["/a/b", "/a/b/c", "/a/x"]
    assert security.authorized(df, text, grants, "you").count() == 4 and security.authorized(df, text, grants, "no").count() == 0


def test_declared_tables():
    made = table_format_of({"a": "VARCHAR(10)", "b": "DECIMAL(5,2)", "c": "[INT]", "d": "[STRING DOUBLE]", "e": "{x:DATE,y:[STRING]}", "f": "[{} INT STRING]"})
    assert [field.dataType.simpleString() for field in made.fields] == [
        "varchar(10)", "decimal(5,2)", "array<int>", "map<string,double>", "struct<x:date,y:array<string>>", "struct<member0:int,member1:string>",
    ]


def test_glob_columns_are_the_glob_texts(spark):
    patterns = ["/a/{b,c?}/*", "/x[!a-c]y", "/q\\*", "/**/end", "/a.b+(c)", "/{a,b*}/**", "/é ü", "[ab]*"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string")
    got = {r["p"]: r["r"] for r in df.select("p", globs.path_glob_regex_column(F.col("p")).alias("r")).collect()}
    paths = ["/a/b/z", "/a/cd/z", "/xdy", "/xay", "/q*", "/qq", "/m/n/end", "/a.b+(c)", "/b1/z/y", "/é ü", "abc", "cab"]
    for pattern in patterns:
        rows = spark.createDataFrame([(p,) for p in paths], "v string")
        one, other = (sorted(r["v"] for r in rows.filter(F.col("v").rlike(x)).collect()) for x in (got[pattern], globs.path_glob_regex(pattern)))
        assert one == other and one, pattern


def test_rule_names_and_lists(spark):
    df = spark.createDataFrame([("a1", ["x"]), ("b1", ["y"]), ("a2", None)], "h string, names array<string>")
    kept = lambda test: sorted(r["h"] for r in df.filter(test).collect())
    assert kept(globs.rule_list(F.col("h"), ["$x"], F.col("names"))) == ["a1"]
    assert kept(globs.rule_list(F.col("h"), ["-$x"], F.col("names"))) == ["a2", "b1"]
    assert kept(globs.rule_lists(F.col("h"), [["a*"], ["-$x"]], F.col("names"))) == ["a2"]


def test_unique_time_uuids(spark):
    df = spark.range(5).select(ids.unique_time_uuid(F.lit(1445019566566), F.col("id")).alias("u"))
    made = [r["u"] for r in df.collect()]
    assert len(set(made)) == 5 and {uuid.UUID(u).version for u in made} == {1} and {uuid.UUID(u).variant for u in made} == {uuid.RFC_4122}
    assert {r[0] for r in df.select(ids.time_uuid_millis(F.col("u"))).collect()} == {1445019566566}
