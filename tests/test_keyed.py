"""Running merges on a stream without one task a key, against the row-by-row chain."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from docsieve.operators.merge import Rules, merge_rows
from docsieve.sources import bucketed
from docsieve.streaming import keyed

SCHEMA = "k string, at bigint, id bigint, v double"


def _rows(start, count, seed):
    draw = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(draw.choice(keys), start + i * 7 + draw.randint(0, 6), start + i, draw.choice([None, 1.0, 2.5, 9.0, -3.0])) for i in range(count)]


def _chain(parts, rules):
    states, out = {}, []
    for part in parts:
        for key in {row[0] for row in part}:
            mine = sorted((row for row in part if row[0] == key), key=lambda row: (row[1], row[2]))
            frame = pd.DataFrame(mine, columns=["k", "at", "id", "v"])
            emitted, states[key] = merge_rows(frame, states.get(key, (0, 0.0, None, None)), ("k",), "at", "id", "v", rules, None)
            out += [(key, r["id"], r["merge_count"], r["merge_sum"], r["pair_min"], r["pair_max"]) for r in emitted]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rules", [Rules(), Rules(every_nth=4), Rules(every_ms=60), Rules(every_ms=90, every_nth=5, below=-2.0), Rules(above=8.0)])
def test_batches_against_the_chain(spark, tmp_path, rules):
    parts = [_rows(0, 60, 1), _rows(1000, 25, 2), _rows(2000, 40, 3)]
    got = {}

    def keep(df, number):
        got[number] = [(r["k"], r["id"], r["merge_count"], r["merge_sum"], r["pair_min"], r["pair_max"]) for r in df.collect()]

    step = keyed.merge_into(f"{tmp_path}/state", ["k"], "at", "v", "id", keep, rules, chunks=5, buckets=4)
    for number, part in enumerate(parts):
        step(spark.createDataFrame(part, SCHEMA), number)
    seen = dict(got)
    step(spark.createDataFrame(parts[-1], SCHEMA), 2)  # run again behind its end
    assert got == seen
    assert sorted((row for rows in got.values() for row in rows), key=repr) == _chain(parts, rules)


def test_failed_batches_idle_keys_and_late_rows(spark, tmp_path):
    got, fail = [], [True]

    def keep(df, number):
        got.append(sorted((r["id"], r["merge_count"]) for r in df.collect()))
        if number == 1 and fail:
            fail.pop()
            raise RuntimeError("lost")

    folder = f"{tmp_path}/state"
    step = keyed.merge_into(folder, ["k"], "at", "v", "id", keep, Rules(every_ms=100), idle_ms=1000, chunks=2, buckets=4)
    step(spark.createDataFrame([("x", 0, 1, 1.0), ("x", 50, 2, 1.0), ("x", 150, 3, 1.0), ("y", 0, 4, 1.0)], SCHEMA), 0)
    late = spark.createDataFrame([("x", 20, 5, 1.0), ("x", 250, 6, 1.0), ("x", 251, 7, None)], SCHEMA)
    with pytest.raises(RuntimeError):
        step(late, 1)
    step(late, 1)
    assert got == [[(1, 1), (3, 3), (4, 1)], [(7, 6)], [(7, 6)]]
    step(spark.createDataFrame([("x", 1200, 8, 1.0), ("y", 1200, 9, 1.0)], SCHEMA), 2)
    assert got[-1] == [(8, 7), (9, 1)]  # y was idle for longer
    step(spark.createDataFrame([], SCHEMA), 3)
    assert got[-1] == []
    step(spark.createDataFrame([("z", 5000, 10, 1.0)], SCHEMA), 4)
    keyed.forget(spark, folder, 2000)
    assert bucketed.read(spark, folder).count() == 1


def test_throttle_runs_once_a_batch(spark, tmp_path):
    plans = []

    def keep(df, number):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    step = keyed.merge_into(f"{tmp_path}/state", ["k"], "at", "v", "id", keep, Rules(every_ms=60), chunks=5, buckets=4)
    step(spark.createDataFrame(_rows(0, 60, 1), SCHEMA), 0)
    assert len(plans) == 1 and "MapInPandas" not in plans[0]
