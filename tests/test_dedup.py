"""Deduplication against two stored buckets: counts per policy, deletions, emission checks."""

from __future__ import annotations

import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docsieve.operators import dedup as dd
from docsieve.operators.dedup import DedupConfig
from docsieve.operators.grouped import GroupReducer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N = 500
SCHEMA = "_id string, dup boolean, dup_field bigint, alt_dup_field bigint, `@timestamp` bigint"


@pytest.fixture(scope="module")
def stores(spark):
    one = [(f"id1_{i}", True, i, i, 0) for i in range(1, N + 1)]
    two = [(f"id2_{i}", False, i, -i, 0) for i in range(1, N + 1)]
    first = spark.createDataFrame(one, SCHEMA).withColumn("__bucket", F.lit("/dedup/context1"))
    second = spark.createDataFrame(two, SCHEMA).withColumn("__bucket", F.lit("/dedup/context2"))
    return first.unionByName(second).cache()


@pytest.fixture(scope="module")
def incoming(spark):
    rows = []
    for i in range(1, 2 * N + 1):
        row = (f"id{i}", True, i, i, 0 if i % 2 == 0 else 1)
        rows += [row] * (2 if i % 10 == 0 else 1)
    seq = [(*row, number) for number, row in enumerate(rows)]
    return spark.createDataFrame(seq, SCHEMA + ", __seq bigint").cache()


def config(policy, fields=("dup_field", "dup"), contexts=("/dedup/*",), **other):
    return DedupConfig(order=("__seq",), policy=policy, fields=fields, contexts=contexts, timestamp="@timestamp", **other)


KEYS = [(("dup_field", "dup"), ("/dedup/*",)), (("alt_dup_field",), ("/dedup/*",)), (("dup_field", "dup"), ("/dedup/context1",))]


def test_disabled_passes_everything(stores, incoming):
    assert dd.dedup(incoming, stores, DedupConfig(order=("__seq",))).emit.count() == 1100


@pytest.mark.parametrize("fields,contexts", KEYS)
@pytest.mark.parametrize("policy,expected", [("leave", 500), ("overwrite", 1000), ("update", 750)])
def test_native_policies(stores, incoming, policy, expected, fields, contexts):
    result = dd.dedup(incoming, stores, config(policy, fields, contexts))
    assert result.emit.count() == expected
    replaced = result.emit.filter(F.col("_id").startswith("id1_")).count()
    assert replaced == {"leave": 0, "overwrite": 500, "update": 250}[policy]
    assert result.delete.count() == 0
    small = dd.dedup(incoming, stores, config(policy, fields, contexts), small_batch=True)
    assert sorted(map(tuple, small.emit.collect())) == sorted(map(tuple, result.emit.collect()))


@pytest.mark.parametrize(
    "policy,finalize,through,old,passed",
    [("custom", False, 1050, 500, 500), ("custom_update", False, 500, 250, 500), ("custom", True, 1600, 500, 0)],
)
def test_custom_groups(stores, incoming, policy, finalize, through, old, passed):
    settings = config(policy, finalize_all=finalize)
    groups = dd.custom_groups(incoming, stores, settings)
    assert groups.count() == through
    assert groups.filter("__injected").count() == old
    assert dd.passed_through(incoming, stores, settings).count() == passed
    sizes = {row["__batch_size"] for row in groups.filter("__injected").select("__batch_size").distinct().collect()}
    assert sizes <= {1, 2}


def test_custom_update_and_finalize_all(stores, incoming):
    # matched and newer: 250 new + 250 old; unmatched: 550 new rows
    groups = dd.custom_groups(incoming, stores, config("custom_update", finalize_all=True))
    assert groups.count() == 1050


def test_overwrite_deletes_surplus(stores, incoming):
    result = dd.dedup(incoming, stores, config("overwrite", ("dup_field",), delete_unhandled=True))
    assert result.emit.count() == 1000
    left = stores.join(result.delete, "_id", "left_anti")
    assert left.count() == 500
    assert left.filter("__bucket = '/dedup/context1'").count() == 500


def test_custom_deletes_what_is_not_emitted_again(stores, incoming):
    settings = config("custom", ("dup_field",), delete_unhandled=True)
    groups = dd.custom_groups(incoming, stores, settings)
    assert groups.count() == 1550
    nothing = groups.select("__key", "_id", "dup_field").limit(0).withColumn("seq", F.lit(1))
    members = groups.filter("__injected").select("__key", "_id")
    checked = dd.check_emissions(nothing, members, F.col("dup_field"), "strict", ["seq"])
    gone = dd.unhandled_ids(checked, members, True)
    assert stores.join(gone, "_id", "left_anti").count() == 0


def test_stats(stores, incoming):
    row = dd.dedup_stats(incoming, stores, config("leave")).first().asDict()
    assert row == {"nonduplicate_keys": 500, "duplicate_keys": 500, "duplicates_incoming": 550, "duplicates_existing": 500, "deleted": 0}
    row = dd.dedup_stats(incoming, stores, config("overwrite", ("dup_field",), delete_unhandled=True)).first().asDict()
    assert row["deleted"] == 500 and row["nonduplicate_keys"] == 1000


def test_update_needs_a_readable_newer_time(spark):
    stored = spark.createDataFrame([("a", 1, None), ("b", 2, "2024-01-01T00:00:00Z"), ("c", 2, "2024-03-01T00:00:00")], "_id string, k int, t string")
    rows = [("n1", 1, "2025-01-01T00:00:00", 1), ("n2", 2, "2024-02-01T00:00:00", 2), ("n3", 3, "junk", 3)]
    new = spark.createDataFrame(rows, "_id string, k int, t string, seq int")
    settings = DedupConfig(order=("seq",), policy="update", fields=("k",), timestamp="t")
    emitted = {row["_id"] for row in dd.dedup(new, stored, settings).emit.collect()}
    assert emitted == {"n3"}  # key 1: stored time unreadable; key 2: newer than one stored row only


def test_rows_without_any_key_field_are_dropped(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 1, None), ("c", 1, None), ("d", None, 2)], "_id string, x int, y int")
    kept = dd.keep_last(rows, ["x", "y"], ["_id"])
    assert {row["_id"] for row in kept.collect()} == {"c", "d"}


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        dd.keep_last(spark.range(3), ["id"], [])
    with pytest.raises(ValueError):
        DedupConfig(order=(), policy="leave").resolved()


EMISSIONS = [
    ("test1", "test_group", (True, True, True)),
    ("test2", "test_group", (True, True, False)),
    (None, "test_group", (True, False, False)),
    (None, "test_group_diff", (True, True, False)),
    ("test4", "test_group", (True, False, False)),
    ("test4", "test_group_diff", (True, True, False)),
    ("delete_me", None, (True, True, False)),
]


@pytest.mark.parametrize("index,policy", list(enumerate(["lax", "strict", "very_strict"])))
def test_emission_policies(spark, index, policy):
    members = spark.createDataFrame([("test_group", f"test{i}") for i in (1, 2, 3)], "__key string, _id string")
    rows = [("test_group", row_id, key, seq) for seq, (row_id, key, _) in enumerate(EMISSIONS)]
    emitted = spark.createDataFrame(rows, "__key string, _id string, grouping_key string, seq int")
    checked = dd.check_emissions(emitted, members, F.col("grouping_key"), policy, ["seq"])
    found = {row["seq"]: row["__ok"] for row in checked.collect()}
    assert [found[seq] for seq in range(len(EMISSIONS))] == [expected[index] for *_, expected in EMISSIONS]
    deleted = lambda unhandled: {row["_id"] for row in dd.unhandled_ids(checked, members, unhandled).collect()}
    assert deleted(False) == (set() if policy == "very_strict" else {"delete_me"})
    assert deleted(True) == ({"test2", "test3"} if policy == "very_strict" else {"delete_me", "test3"})


def test_strict_counts_an_id_once_when_unhandled_ids_are_deleted(spark):
    members = spark.createDataFrame([("g", "a"), ("g", "b")], "__key string, _id string")
    emitted = spark.createDataFrame([("g", "a", "g", 1), ("g", "a", "g", 2), ("g", "a", "other", 3)], "__key string, _id string, k string, seq int")
    check = lambda flag: [row["__ok"] for row in dd.check_emissions(emitted, members, F.col("k"), "strict", ["seq"], delete_unhandled=flag).orderBy("seq").collect()]
    assert check(False) == [True, True, True] and check(True) == [True, False, True]


class Count(GroupReducer):
    def reduce(self, rows):
        return self.merge(pd.DataFrame({"k0": rows["k0"], "n": 1}))

    def merge(self, reduced):
        return reduced.groupby("k0", as_index=False)["n"].sum()


def _count(key, frames):
    yield pd.DataFrame([{"k0": key[0], "n": sum(len(frame) for frame in frames)}])


def test_user_functions_agree(stores, incoming):
    groups = dd.custom_groups(incoming, stores, config("custom", ("dup_field",)))
    reduced = dd.custom_reduce(groups, Count, "k0 bigint, n bigint", "k0 bigint, n bigint", columns=["dup_field"])
    streamed = dd.custom_apply(groups.filter("dup_field < 50"), _count, "k0 bigint, n bigint")
    counts = {row["k0"]: row["n"] for row in reduced.collect()}
    assert sum(counts.values()) == 1550 and len(counts) == 500
    assert {row["k0"]: row["n"] for row in streamed.collect()} == {key: n for key, n in counts.items() if key < 50}


class Echo(GroupReducer):
    """Emits every stored row of a group but the smallest id, the group's key under a foreign id, and a deletion."""

    def reduce(self, rows):
        return pd.DataFrame({"k0": rows["k0"], "ids": [[i] if old else [] for i, old in zip(rows["_id"], rows["__injected"])]})

    def merge(self, reduced):
        return reduced.groupby("k0", sort=False, as_index=False)["ids"].agg(lambda lists: sorted({i for part in lists for i in part}))

    def finish(self, reduced):
        rows = []
        for key, ids in zip(reduced["k0"], reduced["ids"]):
            rows += [(i, key) for i in list(ids)[1:]] + [("foreign", key), (f"gone{key}", None)]
        return pd.DataFrame(rows, columns=["_id", "k"]).astype({"k": "Int64"})


def custom_case(spark, **config):
    new = spark.createDataFrame([("n1", 1, 1), ("n1b", 1, 2), ("n2", 2, 3), ("n9", 9, 4), ("x", None, 5)], "_id string, k bigint, seq bigint")
    old = spark.createDataFrame([("o1", 1), ("o1b", 1), ("o1c", 1), ("o2", 2), ("o7", 7)], "_id string, k bigint")
    config = DedupConfig(order=("seq",), policy="custom", fields=("k",), **config)
    out = dd.dedup_custom(new, old, config, Echo, "k0 bigint, ids array<string>", "_id string, k bigint")
    return [sorted(tuple(r) for r in part.collect()) for part in (out.emit.select("_id", "k"), out.delete, out.errors)]


def test_custom_policy_refuses_foreign_ids_and_deletes_what_is_asked_for(spark):
    emit, delete, errors = custom_case(spark)
    assert emit == [("n9", 9), ("o1b", 1), ("o1c", 1)]
    assert delete == [("gone1",), ("gone2",)] and errors == [("foreign", 1), ("foreign", 2)]


def test_custom_policy_deletes_unhandled_stored_rows(spark):
    emit, delete, errors = custom_case(spark, delete_unhandled=True)
    assert emit == [("n9", 9), ("o1b", 1), ("o1c", 1)] and errors == [("foreign", 1), ("foreign", 2)]
    assert delete == [("gone1",), ("gone2",), ("o1",), ("o2",)]


def test_custom_policy_very_strict_and_lax(spark):
    emit, delete, errors = custom_case(spark, emission="very_strict")
    assert emit == [("foreign", 2), ("n9", 9), ("o1b", 1)] and errors == [("foreign", 1), ("gone1", None), ("gone2", None), ("o1c", 1)]
    assert delete == [("o1",), ("o1c",), ("o2",)]
    emit, delete, errors = custom_case(spark, emission="lax", finalize_all=True)
    assert emit == [("foreign", 1), ("foreign", 2), ("foreign", 9), ("o1b", 1), ("o1c", 1)] and not errors
    assert delete == [("gone1",), ("gone2",), ("gone9",)]


def test_custom_policy_with_composite_keys_and_missing_members(spark):
    class Last(GroupReducer):
        indexed = True

        def reduce(self, rows):
            return rows[["k0", "k1", "_id", "__injected"]].rename(columns={"__injected": "old"})

        def merge(self, reduced):
            return reduced.sort_values("_id").drop_duplicates(["k0", "k1"], keep="last")

        def finish(self, reduced):
            return pd.DataFrame({"_id": reduced["_id"], "a": reduced["k0"], "b": reduced["k1"]})

    new = spark.createDataFrame([("n1", "x", None, 1), ("n2", "x", "y", 2), ("n3", None, None, 3)], "_id string, a string, b string, seq bigint")
    old = spark.createDataFrame([("o1", "x", None), ("o2", "x", "y"), ("o3", "z", "y")], "_id string, a string, b string")
    config = DedupConfig(order=("seq",), policy="custom", fields=("a", "b"), delete_unhandled=True)
    out = dd.dedup_custom(new, old, config, Last, "k0 string, k1 string, _id string, old boolean", "_id string, a string, b string")
    assert sorted((tuple(r) for r in out.emit.select("_id", "a", "b").collect()), key=str) == [("o1", "x", None), ("o2", "x", "y")]
    assert out.delete.count() == 0 and out.errors.count() == 0
