"""Stores of hash buckets: only touched buckets are written, content as by a whole rewrite."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docsieve.operators.dedup import DedupConfig
from docsieve.sources import bucketed
from docsieve.streaming.stored import dedup_into_buckets


def test_changes_against_a_dictionary(spark, tmp_path):
    folder, draw, want = f"{tmp_path}/store", random.Random(11), {}
    bucketed.create(spark, folder, "id", 8)
    with pytest.raises(LookupError):
        bucketed.read(spark, folder)
    for step in range(5):
        put = {draw.randint(0, 60): draw.choice([None, "x", "y"]) for _ in range((40, 3, 0, 5, 2)[step])}
        gone = [draw.randint(0, 80) for _ in range((0, 2, 0, 3, 1)[step])]
        before = bucketed.manifest(spark, folder).folders
        rows = spark.createDataFrame(list(put.items()), "id long, v string")
        numbers = bucketed.change(spark, folder, rows, spark.createDataFrame([(i,) for i in gone + gone], "id long"))
        after = bucketed.manifest(spark, folder).folders
        assert {n for n in range(8) if before.get(n) != after.get(n)} <= set(numbers)
        assert all(after.get(n) == before.get(n) for n in set(range(8)) - set(numbers))
        want = {i: v for i, v in want.items() if i not in gone} | put
        assert {tuple(r) for r in bucketed.read(spark, folder).collect()} == set(want.items())
        assert bucketed.read(spark, folder).count() == len(want)
    some = spark.createDataFrame([(i,) for i in (*list(want)[:2], 999)], "id int")  # another type of number, same bucket
    found = bucketed.read_ids(spark, folder, some)
    assert sorted(r["id"] for r in found.collect()) == sorted(list(want)[:2])
    assert len(found.inputFiles()) <= 3
    old = bucketed.manifest(spark, folder)
    stale = bucketed.remove_unnamed(spark, folder)
    assert stale and {tuple(r) for r in bucketed.read(spark, folder).collect()} == set(want.items())
    assert bucketed.manifest(spark, folder) == old and bucketed.remove_unnamed(spark, folder) == []


def test_columns_nulls_and_refusals(spark, tmp_path):
    folder = f"{tmp_path}/store"
    bucketed.create(spark, folder, "id", 4)
    bucketed.change(spark, folder, spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v long"))
    numbers = bucketed.change(spark, folder, spark.createDataFrame([("a", True), (None, False)], "id string, w boolean"))
    assert 1 <= len(numbers) <= 2
    got = {(r["id"], r["v"], r["w"]) for r in bucketed.read(spark, folder).collect()}
    assert got == {("a", None, True), ("b", 2, None), (None, 3, None), (None, None, False)}
    with pytest.raises(ValueError):
        bucketed.change(spark, folder, spark.createDataFrame([("a", "text")], "id string, v string"))
    with pytest.raises(FileExistsError):
        bucketed.create(spark, folder, "id", 4)
    # rows computed from the store itself; and the last row of the store goes
    bucketed.change(spark, folder, bucketed.read(spark, folder).filter("id = 'b'").withColumn("v", F.col("v") + 1), None)
    assert bucketed.read(spark, folder).filter("id = 'b'").first()["v"] == 3
    whole = bucketed.read(spark, folder)
    bucketed.change(spark, folder, None, whole.filter("id IS NOT NULL"))
    assert bucketed.read(spark, folder).filter("id IS NOT NULL").count() == 0


def test_stream_handler_is_idempotent(spark, tmp_path):
    folder = f"{tmp_path}/store"
    handle = dedup_into_buckets(folder, DedupConfig(order=("seq",), policy="overwrite", fields=("k",)), buckets=16)
    one = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 1, 3)], "_id string, k int, seq int")
    two = spark.createDataFrame([("d", 1, 4), ("e", 3, 5)], "_id string, k int, seq int")
    for frame, batch_id in ((one, 0), (two, 1), (two, 1), (one, 0)):
        handle(frame, batch_id)
    assert {tuple(row) for row in bucketed.read(spark, folder).collect()} == {("c", 1, 4), ("b", 2, 2), ("e", 3, 5)}
    assert bucketed.manifest(spark, folder).marks == {"": 1}
