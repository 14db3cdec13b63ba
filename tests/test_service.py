"""Services as Spark sources: splits, pushed filters, chosen columns, streams."""

from __future__ import annotations

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

import docsieve
from docsieve.sources import service

cloudpickle.register_pickle_by_value(docsieve)


@pytest.fixture
def rows(spark, tmp_path):
    service.register(spark, "parts", service.ParquetParts)
    df = spark.range(0, 400, 1, 4).select(
        "id", (F.col("id") % 7).cast("int").alias("v"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("t"),
        F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 3).alias("d"),
    )
    df.write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


CONDITIONS = ["id = 7", "v > 3 AND id < 100", "t = 't1'", "t IS NULL", "t IS NOT NULL AND v <= 2", "NOT (v = 3)", "NOT (t = 't1')", "v IN (1, 2)", "t IN ('t0', NULL)",
              "NOT (t IN ('t0', 't2'))", "t LIKE 't2%'", "t > 't1'", "d > 100", "d = 'NaN'", "id = 1 OR v = 2", "t <=> NULL", "id >= 390 AND d IS NOT NULL"]


@pytest.mark.parametrize("text", CONDITIONS)
def test_filters_mean_the_same(spark, rows, text):
    want = sorted(r["id"] for r in spark.read.parquet(rows).filter(text).collect())
    assert sorted(r["id"] for r in service.scan(spark, "parts", path=rows).filter(text).collect()) == want


def test_filters_are_pushed_and_splits_are_tasks(spark, rows):
    wanted = service.scan(spark, "parts", path=rows).filter("v > 3 AND t = 't1'")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(wanted._jdf.queryExecution(), "formatted")
    assert "GreaterThan(v,3)" in plan and "EqualTo(t,t1)" in plan
    assert "Filter" not in plan.split("\n\n")[0]  # nothing is left for Spark to test
    assert service.scan(spark, "parts", path=rows).rdd.getNumPartitions() == 4
    some = service.scan(spark, "parts", ["t", "id"], path=rows)
    assert some.columns == ["t", "id"] and some.count() == 400


def test_conditions_that_stay_with_spark(spark, rows):
    schema = spark.read.parquet(rows).schema
    assert service.condition(ds.GreaterThan(("d",), 1.0), schema) is None
    assert service.condition(ds.EqualTo(("s", "x"), 1), schema) is None
    assert service.condition(ds.In(("v",), (1, None)), schema) is None
    assert service.condition(ds.Not(ds.StringContains(("t",), "x")), schema) is None


def test_stream_goes_on_behind_its_offset(spark, rows, tmp_path):
    def run():
        stream = spark.readStream.format("parts").option("path", f"{tmp_path}/live").load()
        sink = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark")
        running = sink.start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    for step, low in (("1", 0), ("2", 100)):
        spark.range(low, low + 100, 1, 2).write.parquet(f"{tmp_path}/live/step={step}")
        assert run() == list(range(low + 100))
    assert run() == list(range(200))  # nothing new
