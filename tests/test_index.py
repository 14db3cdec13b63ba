"""Search on a stored index against search on texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docsieve.operators.index import _of_terms, _words, build_index, indexed_search
from docsieve.operators.search import parse_search, search

WORDS = ["the", "of", "and", "rare", "Ärger", "x9", "long", "tail"]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    weights = [30, 20, 10, 1, 2, 3, 5, 4]
    rows = [(i, " ".join(draw.choices(WORDS, weights, k=int(2 ** (draw.random() * 9))))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "rare"), (1004, "THE the, The-the"), (1005, "rare"), (None, "the rare")]
    return spark.createDataFrame(rows, "id long, text string").cache()


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory):
    return build_index(docs, "id", "text", str(tmp_path_factory.mktemp("index")) + "/i", buckets=7)


@pytest.mark.parametrize("words", ["the", "rare", "the and", "the|rare", "ärger|x9 of -long", "the -rare", "nowhere", "nowhere|the", "the nowhere"])
@pytest.mark.parametrize("limit", [None, 1, 7])
def test_same_as_search(spark, docs, stored, words, limit):
    query = parse_search(words)
    want = search(docs.filter("id is not null"), "text", query, tie="id", limit=limit, fields=["id"]).collect()
    found = indexed_search(spark, stored, query, limit)
    assert [(r["id"], round(r["score"], 6)) for r in found.hits.collect()] == [(r["id"], round(r["score"], 6)) for r in want]


def test_best_hits_skip_blocks_of_short_texts(spark, stored):
    found = indexed_search(spark, stored, parse_search("the of"), 3)
    assert found.skipped and len(found.read) < len(found.skipped)
    assert not indexed_search(spark, stored, parse_search("the of")).skipped


def test_only_folders_of_the_terms_are_read(spark, stored):
    plan = indexed_search(spark, stored, parse_search("rare"), 2).hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "EqualTo(term,rare)" in plan
    files = _of_terms(spark, stored, "postings", ["rare"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].split("bucket=")[1].split("/")[0] for r in files}) == 1


def test_other_rows_and_empty_tables(spark, docs, stored, tmp_path):
    allowed = docs.filter("id % 2 = 0").select("id")
    want = search(docs.filter("id % 2 = 0"), "text", parse_search("rare"), tie="id", fields=["id"]).select("id").collect()
    got = indexed_search(spark, stored, parse_search("rare"), rows=allowed).hits.select("id").collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in want)
    with pytest.raises(ValueError):
        indexed_search(spark, stored, parse_search("-rare"))
    empty = build_index(docs.filter("false"), "id", "text", f"{tmp_path}/empty", buckets=3)
    assert indexed_search(spark, empty, parse_search("the"), 5).hits.count() == 0


def test_texts_are_split_once(docs):
    words = _words(docs, "id", "text")
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower") == 1
    assert sorted(r["term"] for r in words.filter("id in (1000, 1001, 1002, 1004)").collect()) == ["the"] * 4
