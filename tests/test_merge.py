"""Keyed merges and emission rules: known counts, and hot-key paths against brute force."""

from __future__ import annotations

import datetime as dt
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docsieve.operators import merge as mg
from docsieve.operators.ordered import Running, in_chunks, running

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = dt.datetime(2024, 1, 1)


def log_rows(spark, keys, values):
    """One row per (value, key), interleaved, a millisecond apart."""
    rows = [(key, float(value), START + dt.timedelta(milliseconds=number)) for number, (value, key) in enumerate((v, k) for v in values for k in keys)]
    return spark.createDataFrame([(*row, seq) for seq, row in enumerate(rows)], "merge_key string, value double, date timestamp_ntz, seq int")


@pytest.fixture(scope="module")
def logs(spark):
    return log_rows(spark, ["key1"], range(50)).cache()


ORDER = ["date", "seq"]


def test_rule_counts(logs):
    merged = mg.running_merge(logs, ["merge_key"], ORDER, F.col("value"))
    value = F.col("value")
    assert mg.throttle(logs, ["merge_key"], ORDER, 500_000).count() == 1
    assert mg.every_nth(logs, ["merge_key"], ORDER, 5).count() == 10
    # the nested rule reads the latest value: 7..49 pass above, and below 1 only the first
    assert mg.emit_any(merged, [mg.rule_outside(value, high=6.0)]).count() == 43
    assert mg.emit_any(merged, [mg.rule_outside(value, low=1.0)]).count() == 1
    assert mg.emit_any(merged, [mg.rule_outside(value, 1.0, 6.0)]).count() == 44
    assert mg.emit_any(merged, []).count() == 50


def test_rule_counts_of_values_from_one(spark):
    # values 1..50, as in the recorded counts: 44 above 6, 27 for "every 2nd or above 45"
    logs = log_rows(spark, ["key1"], range(1, 51))
    merged = mg.running_merge(logs, ["merge_key"], ORDER, F.col("value"))
    above = mg.rule_outside(F.col("value"), high=6.0)
    assert mg.emit_any(merged, [above]).count() == 44
    assert mg.emit_any(merged, [mg.rule_every_nth(2), mg.rule_outside(F.col("value"), high=45.0)]).count() == 27


def test_merges(spark):
    rows = spark.createDataFrame([("k", 1, "msg2", 4.66), ("k", 2, "msg1", 5.2)], "key string, seq int, message string, v double")
    assert mg.merge_append(rows, ["key"], "message", ["seq"]).first()["message"] == "msg1 msg2"
    got = mg.merge(rows, ["key"], {"s": mg.merge_sum(F.col("v")), "lo": mg.merge_min(F.col("v")), "hi": mg.merge_max(F.col("v")), "n": mg.merge_count(), "last": mg.latest(F.col("message"), ["seq"])}).first()
    assert (round(got["s"], 2), got["lo"], got["hi"], got["n"], got["last"]) == (9.86, 4.66, 5.2, 2, "msg1")


def test_append_of_long_and_short_ranges(spark):
    rng = random.Random(3)
    rows = [(key, rng.random() * 10**rng.randint(0, 6), seq) for key in range(5) for seq in range(rng.choice([1, 2, 300]))]
    df = spark.createDataFrame([(key, at, seq, f"m{seq}") for key, at, seq in rows], "key int, at double, seq int, m string")
    for chunks in (1, 6):
        merged = mg.merge_append(df, ["key"], "m", ["at", "seq"], out="m", chunks=chunks)
        got = {row["key"]: row["m"] for row in merged.collect()}
        for key in {row[0] for row in rows}:
            ordered = sorted(((at, seq) for k, at, seq in rows if k == key), reverse=True)
            assert got[key] == " ".join(f"m{seq}" for _, seq in ordered)


def test_overlay(spark):
    rows = spark.createDataFrame([("k", 1, {"a": 1.0, "b": 1.0}), ("k", 3, {"b": 3.0}), ("k", 2, {"b": 2.0, "c": 2.0})], "key string, seq int, details map<string,double>")
    assert mg.merge_overlay(rows, ["key"], "details", ["seq"]).first()["details"] == {"a": 1.0, "b": 3.0, "c": 2.0}


def skewed(seed):
    """A third of all rows under one key, bursts and gaps, ties in time, missing values and a missing key."""
    rng = random.Random(seed)
    rows, at = [], 0
    for seq in range(900):
        at += rng.choice([0, 0, 1, 3, 20, 400])
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])
        rows.append((key, START + dt.timedelta(milliseconds=at), seq, None if rng.random() < 0.2 else round(rng.random() * 10, 2)))
    return rows


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunks", [1, 7])
def test_running_merge_against_brute_force(spark, seed, chunks):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, seq int, v double")
    got = {
        row["seq"]: (row["merge_count"], round(row["merge_sum"], 6), row["pair_min"], row["pair_max"], row["running_min"], row["running_max"])
        for row in mg.running_merge(df, ["k"], ["t", "seq"], F.col("v"), chunks=chunks).collect()
    }
    for group in by_key(rows).values():
        total, last, seen = 0.0, None, []
        for number, (_, _, seq, value) in enumerate(group, 1):
            pair = [each for each in (last, value) if each is not None]
            seen += [value] if value is not None else []
            total += value or 0.0
            last = value if value is not None else last
            expected = (number, round(total, 6), min(pair, default=None), max(pair, default=None), min(seen, default=None), max(seen, default=None))
            assert got[seq] == expected


def expected_throttle(group, period, forced=lambda number, row: False):
    mark, kept = None, []
    for number, row in enumerate(group, 1):
        at = (row[1] - START) // dt.timedelta(milliseconds=1)
        if mark is None or at - mark > period or forced(number, row):
            kept.append(row[2])
            mark = at
    return kept


@pytest.mark.parametrize("period", [0, 5, 50, 1_000, 10**7])
@pytest.mark.parametrize("chunks", [1, 9])
def test_throttle_against_brute_force(spark, period, chunks):
    rows = skewed(5)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, seq int, v double")
    got = {row["seq"] for row in mg.throttle(df, ["k"], ["t", "seq"], period, chunks=chunks).collect()}
    assert got == {seq for group in by_key(rows).values() for seq in expected_throttle(group, period)}


@pytest.mark.parametrize("period", [5, 1_000])
def test_throttle_with_other_rules(spark, period):
    rows = skewed(8)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, seq int, v double")
    got = {row["seq"] for row in mg.throttle(df, ["k"], ["t", "seq"], period, F.col("v") > 9, chunks=9).collect()}
    want = {seq for group in by_key(rows).values() for seq in expected_throttle(group, period, lambda _, row: (row[3] or 0) > 9)}
    assert got == want


def test_a_hot_key_lies_in_many_chunks(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    assert in_chunks(df.filter("k = 'hot'"), ["k"], ["id"], 8).select("__chunk").distinct().count() > 4
    got = running(df, ["k"], ["id"], {"n": Running("count")}, chunks=8)
    assert got.filter("k = 'hot' and n = id + 1").count() == 400 and got.filter("k <> 'hot' and n = 1").count() == 600


def test_plans_are_built_without_a_job_and_keys_are_cut_by_size(spark, monkeypatch):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    spark.sparkContext.setJobGroup("building", "")
    running(df, ["k"], ["id"], {"n": Running("count")})
    in_chunks(df, [], ["id"])
    mg.throttle(df.withColumn("at", F.timestamp_millis("id")), ["k"], ["at", "id"], 50)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    # a small table is one chunk a key; with a lower bound the large key alone is cut, into chunks of about that size
    assert in_chunks(df, ["k"], ["id"]).filter("__cut or __chunk > 0").count() == 0
    monkeypatch.setattr("docsieve.operators.ordered.CHUNK_ROWS", 1_000)
    sizes = {(r["k"], r["__chunk"]): r["count"] for r in in_chunks(df, ["k"], ["id"]).filter("__cut").groupBy("k", "__chunk").count().collect()}
    assert {key for key, _ in sizes} == {"hot"} and 12 <= len(sizes) <= 16 and max(sizes.values()) < 1_500 and sum(sizes.values()) == 14_000
    assert in_chunks(df, [], ["id"]).groupBy("__chunk").count().filter("count < 1500").count() > 15


def test_rows_are_shuffled_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit("x").alias("payload"))
    plan = running(df, ["k"], ["id"], {"n": Running("count")})._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    assert sum("Exchange hashpartitioning" in line and "__chunk" in line for line in plan.splitlines()) <= 2  # rows, and sums of chunks


@pytest.mark.parametrize("chunks", [1, 4, 50])
def test_empty_tables_and_equal_rows(spark, chunks):
    empty = spark.createDataFrame([], "k string, at int")
    assert running(empty, ["k"], ["at"], {"n": Running("count")}, chunks).count() == 0
    assert running(empty, [], ["at"], {"n": Running("count")}, chunks).count() == 0
    equal = spark.createDataFrame([("a", 1)] * 30 + [("a", None)] * 5 + [("b", 2)], "k string, at int")
    got = running(equal, ["k"], ["at"], {"n": Running("count")}, chunks)
    assert sorted(r["n"] for r in got.filter("k = 'a'").collect()) == list(range(1, 36))
    assert {r["n"] for r in got.filter("at is null").collect()} == set(range(1, 6))


@pytest.mark.parametrize("chunks", [1, 6])
def test_any_order_type_ties_and_nulls(spark, chunks):
    # text order, a first order column that ties throughout, and nulls
    rows = [("hot", "same", None if i == 0 else f"{i:05d}") for i in range(300)] + [(None, None, f"{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "k string, first string, then string")
    got = {(r["k"], r["then"]): (r["n"], r["p"]) for r in running(df, ["k"], ["first", "then"], {"n": Running("count"), "p": Running("previous", F.col("then"))}, chunks).collect()}
    assert got[("hot", None)] == (1, None) and got[("hot", "00001")] == (2, None) and got[("hot", "00299")] == (300, "00298") and got[(None, "2")] == (3, "1")


@pytest.mark.parametrize("chunks", [1, 6])
def test_rows_without_time_neither_emit_nor_mark(spark, chunks):
    rows = [("k", None, i, True) for i in range(8)] + [("k", START + dt.timedelta(milliseconds=10 * i), 100 + i, False) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, seq int, f boolean")
    got = sorted(r["seq"] for r in mg.throttle(df, ["k"], ["t", "seq"], 99, F.col("f"), chunks).collect())
    assert got == [100, 110, 120, 130, 140]


def test_pieces(spark):
    df = spark.createDataFrame([("k", i, f"m{i}") for i in range(40)], "key string, at int, m string")
    pieces = mg.append_pieces(df, ["key"], "m", ["at"], chunks=5).orderBy("piece").collect()
    assert len(pieces) > 1 and " ".join(p["text"] for p in pieces) == " ".join(f"m{i}" for i in reversed(range(40)))


def test_order_is_required(spark):
    with pytest.raises(ValueError):
        running(spark.range(3), ["id"], [], {"n": Running("count")})


def _tenth(row):
    return {**row, "merge_sum": row["merge_sum"] / 10, "merge_count": row["merge_count"] + 2}


def _folded(rows, rules, formatter):
    """The rules and the formatter row by row."""
    out, states = [], {}
    for key, at, tie, value in sorted(rows, key=lambda r: (r[1], r[2])):
        count, total, last, mark = states.get(key, (0, 0.0, None, None))
        count, total = count + 1, total + (value or 0.0)
        known = [v for v in (last, value) if v is not None]
        last = value if value is not None else last
        if rules.passes(count, at, mark, value):
            mark = at
            row = formatter({"merge_count": count, "merge_sum": total, "pair_min": min(known, default=None), "pair_max": max(known, default=None)})
            count, total = row["merge_count"], row["merge_sum"]
            out.append((key, tie, at, row["merge_count"], round(row["merge_sum"], 9), row["pair_min"], row["pair_max"]))
        states[key] = count, total, last, mark
    return sorted(out, key=str)


@pytest.mark.parametrize("rules", [mg.Rules(every_nth=4), mg.Rules(every_ms=50), mg.Rules(below=1.0, above=8.5), mg.Rules()])
def test_feedback_is_the_same_at_any_number_of_chunks(spark, rules):
    draw = random.Random(7)
    rows = [("hot" if i % 3 else draw.choice(["a", "b", None]), draw.randint(0, 900), i, None if i % 11 == 0 else round(draw.random() * 10, 3)) for i in range(400)]
    df = spark.createDataFrame(rows + [("hot", None, 1000, 1.0)], "k string, at bigint, id bigint, v double")
    want = _folded(rows, rules, _tenth)
    for chunks in (1, 8):
        out = mg.merged_with_feedback(df, ["k"], "at", "id", "v", rules, _tenth, chunks=chunks)
        got = sorted(((*tuple(r)[:4], round(r["merge_sum"], 9), r["pair_min"], r["pair_max"]) for r in out.collect()), key=str)
        assert got == want
    assert mg.merged_with_feedback(df.filter("false"), ["k"], "at", "id", "v", rules, _tenth).count() == 0


def _rows_at_once(row):
    """Emitted rows tell how many rows of the key were in Python together."""
    return {**row, "merge_sum": float(len(sys._getframe(1).f_locals["rows"]))}


def test_feedback_takes_a_key_in_arrow_batches(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["hot", "hot", "a", None]), draw.randint(0, 90), i, draw.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at bigint, id bigint, v double")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "10")
    try:
        assert mg.merged_with_feedback(df, ["k"], "at", "id", "v", mg.Rules(), _rows_at_once, chunks=1).agg(F.max("merge_sum")).first()[0] <= 10
        rules = mg.Rules(every_nth=3, every_ms=40)
        for chunks in (1, 4):
            out = mg.merged_with_feedback(df, ["k"], "at", "id", "v", rules, _tenth, chunks=chunks)
            got = sorted(((*tuple(r)[:4], round(r["merge_sum"], 9), r["pair_min"], r["pair_max"]) for r in out.collect()), key=str)
            assert got == _folded(rows, rules, _tenth)
    finally:
        spark.conf.unset(setting)


def test_replay_of_many_groups():
    at = np.array([0, 5, 10, 3, 4, 30, 31, 1, 2], np.int64)
    forced = np.array([0, 0, 0, 0, 1, 0, 0, 0, 1], bool)
    # groups 0-2, 3-6 and 7-8: without a mark, behind a mark, and behind one that lets only the forced row through
    assert mg._emitted(at, forced, [0, 3, 7], [None, 1, 100], 6) == [0, 2, 4, 5, 8]
    assert mg._emitted(at[:0], forced[:0], [], [], 6) == []
