"""Compare every registered query with its SQL counterpart on a data folder: python tests/check_queries.py [folder] [name ...]."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    if isinstance(value, dict):
        return tuple(sorted((key, _plain(item)) for key, item in value.items()))
    return value


def _kind(value):
    return "number" if isinstance(value, Decimal) else type(value).__name__


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    return sorted((tuple(_plain(row[index]) for index in order) for row in rows), key=repr)


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    connection.sql("SET TimeZone='UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return connection


def compare(spark, connection, folder, name, builder, sql):
    """(ok, message) of one query."""
    start = time.time()
    df = builder(spark, folder)
    columns = df.columns
    rows = [tuple(row) for row in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(rows), f"rows only: {len(rows)} rows, {took:.2f}s", took
    result = connection.sql(sql)
    expected_columns = result.columns
    expected = result.fetchall()
    if sorted(columns) != sorted(expected_columns):
        return False, f"columns {columns} / {expected_columns}", took
    left, right = canonical(columns, rows), canonical(expected_columns, expected)
    if left != right:
        different = [pair for pair in zip(left, right) if pair[0] != pair[1]][:3]
        return False, f"{len(left)} / {len(right)} rows, first differences {different}", took
    if rows and expected:
        mine = {column: _kind(value) for row in rows for column, value in zip(columns, row) if value is not None}
        theirs = {column: _kind(value) for row in expected for column, value in zip(expected_columns, row) if value is not None}
        for column in mine.keys() & theirs.keys():
            if mine[column] != theirs[column]:
                return False, f"type of {column}: {mine[column]} / {theirs[column]}", took
    return True, f"{len(rows)} rows, {took:.2f}s" + ("" if rows else " EMPTY"), took


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    from docsieve import tuned_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    }
    if os.environ.get("CHECK_PLAIN"):
        # Spark's own defaults and a zone with daylight saving: results must not depend on the library's session settings
        builder = SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "America/New_York")
        for key, value in settings.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()
    else:
        spark = tuned_session(master="local[8]", **{key.replace(".", "__"): value for key, value in settings.items()})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    sql = entry.oracle_sql()
    failures = 0
    for name, builder in entry.queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        try:
            ok, message, _ = compare(spark, connection, folder, name, builder, sql.get(name))
        except Exception as error:  # report and go on with the next query
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        failures += not ok
        if not ok or wanted or "EMPTY" in message or not sql.get(name):
            print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
