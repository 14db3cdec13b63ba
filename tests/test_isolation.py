"""Rows on which a user module raises become rows of the error channel."""

from __future__ import annotations

import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle

from docsieve.operators.grouped import BatchModule, batch_isolated, isolate

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Inverse(BatchModule):
    def setup(self, options):
        self.unit, self.done = options.get("unit", 1.0), 0

    def batch(self, rows):
        if (rows["v"] == 0).any():
            raise ZeroDivisionError("no inverse")
        self.done += len(rows)
        return rows[["id"]].assign(inverse=self.unit / rows["v"])

    def complete(self):
        return pd.DataFrame({"id": [-1], "inverse": [float(self.done)]})


class Broken(BatchModule):
    def complete(self):
        raise RuntimeError("at the end")


def test_halving_calls_few_times():
    calls = []

    def fn(rows):
        calls.append(len(rows))
        if (rows["v"] == 0).any():
            raise ValueError("zero")
        return rows

    rows = pd.DataFrame({"v": [1] * 700 + [0] + [1] * 323})
    outputs, failed = isolate(fn, rows)
    assert failed == [(700, "ValueError: zero")] and sum(map(len, outputs)) == 1023 and len(calls) <= 21
    assert isolate(fn, rows.iloc[:0]) == ([], [])
    outputs, failed = isolate(fn, pd.DataFrame({"v": [0, 0, 0]}))
    assert not outputs and [place for place, _ in failed] == [0, 1, 2]


def test_failing_rows_do_not_end_the_job(spark):
    rows = [(i, float(i % 50), f"t{i}") for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "id long, v double, text string").repartition(3)
    good, errors = batch_isolated(df, Inverse, "id long, inverse double", {"unit": 2.0})
    kept = {r["id"]: r["inverse"] for r in good.collect() if r["id"] > 0}
    assert kept == {i: 2.0 / v for i, v, _ in rows if v}
    assert sum(r["inverse"] for r in good.filter("id = -1").collect()) == 980  # every good row is counted once
    failed = errors.collect()
    assert {r["__error"] for r in failed} == {"ZeroDivisionError: no inverse"}
    assert sorted((json.loads(r["__row"])["id"], json.loads(r["__row"])["text"]) for r in failed) == [(i, f"t{i}") for i in range(50, 1001, 50)]


def test_nothing_to_blame_ends_the_job(spark):
    df = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(Exception, match="at the end"):
        batch_isolated(df, Broken, "id long")
    good, errors = batch_isolated(spark.createDataFrame([], "id long, v double"), Inverse, "id long, inverse double")
    assert errors.count() == 0 and good.filter("id > 0").count() == 0
