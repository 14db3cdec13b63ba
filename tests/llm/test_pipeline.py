"""The corpus pipeline, stage by stage against plain rules, and the registered queries."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest

import corpus_pipeline
from check_queries import compare, connect
from docsieve.llm import queries
from docsieve.llm.common import saved
from test_pairs import brute_groups
from test_text import brute_contamination

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with planted cases, a clashing column and rows that repeat."""
    out = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    item = bench.orderBy("item_id").first()["text"]
    clean = docs.where("length(text) > 800").orderBy("doc_id").first()
    extra = [
        (9000, clean["text"], clean["lang"], "src0", 1), (9001, clean["text"] + " end", clean["lang"], "src0", 1), (9002, "Before. " + item + " After.", "en", "src0", 1),
        (9003, "you idiot moron stupid scum and " * 3 + "the thing that was on the hand of it", "en", "src0", 1), (9004, None, None, None, None), (9005, "123 !!", "en", None, None),
        (9006, "the thing on hand and that with others of them was for all in it", "en", "src1", 9), (9006, "the thing on hand and that with others of them was for all in it", "en", "src1", 9),
    ]
    extra = spark.createDataFrame(extra, docs.schema)
    docs.unionByName(extra).selectExpr("*", "'x' as ids", "1 as kept").write.parquet(f"{out}/documents.parquet")
    bench.write.parquet(f"{out}/benchmark.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = saved(stage(spark, docs, folder), "test-stage")
        after = docs.collect()
        kept = {r["doc_id"] for r in after}
        seen[name] = kept
        if name != "tokens":
            assert docs.columns == columns and {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "toxicity":
            assert 9003 not in kept and {9000, 9004, 9006} <= kept and len(after) > 0.8 * len(before)
        if name == "language":
            assert not {9004, 9005} & kept and 9006 in kept and len(after) > 0.93 * len(before)
        if name == "near duplicates":
            _, groups = brute_groups([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert kept == {i for i, least in groups.items() if i == least} and not {9000, 9001} & kept
            assert len(after) == len(kept)  # the repeated row stays once
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            clean = set()
            for r in before:
                n, hit, _ = brute_contamination(r["text"], items, 13)
                if not (hit > 0 and 20 * hit >= n):
                    clean.add(r["doc_id"])
            assert kept == clean and 9002 not in kept
        if name == "tokens":
            import public_tokenizers
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            texts = {r["doc_id"]: r["text"] for r in before}
            for r in after:
                ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
                assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near duplicates", "decontamination", "tokens"]


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, connection, name):
    ok, message, _ = compare(spark, connection, FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


COLUMNS = {
    "op4_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op8_bpe_round_trip": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op10_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op11_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_its_table(spark, name):
    out = queries.QUERIES[name](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert COLUMNS[name] <= set(out.columns)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_every_query_is_compared_with_sql_or_has_its_columns_and_ids_checked():
    assert set(queries.QUERIES) == set(queries.ORACLES) | set(COLUMNS)


@pytest.mark.parametrize("name", ["op8_bpe_round_trip", "op10_token_counts"])
def test_token_queries_against_the_library(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json" if name.startswith("op8") else "byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.QUERIES[name](spark, FOLDER).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        if name.startswith("op8"):
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        else:
            assert r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (len(ids) > 1024)
