"""Cursor pages: joined they are one sorted read, whatever ties, nulls and buckets there are."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docsieve.operators import paging


def _key(row, order):
    parts = []
    for name, sign in order:
        value = row[name]
        null = value is None
        if isinstance(value, str):
            number = tuple(ord(char) * sign for char in value) + ((1,) if sign < 0 else ())
        else:
            number = 0 if null else value * sign
        first = 0 if null else 1
        parts.append((first if sign > 0 else -first, 0 if null else number))
    return (*parts, row["__bucket"], row["id"])


@pytest.mark.parametrize("order", [[("a", 1)], [("a", -1)], [("b", 1), ("a", -1)], [("b", -1), ("a", 1)], []])
def test_pages_are_one_sorted_read(spark, order):
    draw = random.Random(3)
    rows = {
        f"/p/{name}": [(i, draw.choice([None, 1, 2, 2, 3]), draw.choice([None, "x", "y", "xy"])) for i in range(size)]
        for name, size in (("one", 9), ("two", 14), ("none", 0))
    }
    frames = {name: spark.createDataFrame(part, "id long, a long, b string").coalesce(1) for name, part in rows.items()}
    flat = [{"__bucket": name, "id": r[0], "a": r[1], "b": r[2]} for name, part in rows.items() for r in part]
    want = [(r["__bucket"], r["id"]) for r in sorted(flat, key=lambda r: _key(r, order))]
    got, cursor = [], None
    while True:
        part = paging.page(frames, order, 7, "id", cursor).collect()
        if not part:
            break
        got += [(r["__bucket"], r["id"]) for r in part]
        cursor = paging.cursor_of(part[-1], order, "id")
    assert got == want


def test_range_reaches_the_scan_and_columns_may_be_missing(spark, tmp_path):
    spark.range(50).select(F.col("id"), (F.col("id") % 5).alias("a")).write.parquet(f"{tmp_path}/full")
    spark.range(3).write.parquet(f"{tmp_path}/short")
    frames = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in ("full", "short")}
    first = paging.page(frames, [("a", 1)], 5, "id")
    assert [(r["a"], r["__bucket"], r["id"]) for r in first.collect()][:4] == [(None, "short", 0), (None, "short", 1), (None, "short", 2), (0, "full", 0)]
    later = paging.page({"full": frames["full"]}, [("a", 1)], 5, "id", {"a": 3, "__bucket": "full", "id": 20})
    assert "GreaterThanOrEqual(a,3)" in later._jdf.queryExecution().toString()
    assert [r["id"] for r in later.collect()] == [23, 28, 33, 38, 43]
    assert paging.last_row(first, [("a", 1)], "id")["id"] == 5


def test_bad_arguments(spark):
    rows = spark.range(2)
    for call in (
        lambda: paging.page({}, [], 1, "id"),
        lambda: paging.page({"x": rows}, [], 0, "id"),
        lambda: paging.page({"x": rows}, [("id", 1)], 1, "id"),
        lambda: paging.page({"x": rows}, [], 1, "id", {"id": 3}),
    ):
        with pytest.raises((ValueError, LookupError)):
            call()
