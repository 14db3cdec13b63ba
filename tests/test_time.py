"""Periods, suffixes, dated folders and slices."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsieve.functions import timefn
from docsieve.operators import timeslice

NOW = dt.datetime(2015, 6, 12, 2, 0)


def test_periods():
    assert [timefn.period_of(text) for text in ("1d", "Daily", " 1 month", "wk", "yr", "min", "s", "hourly")] == [
        "day", "day", "month", "week", "year", "minute", "second", "hour",
    ]
    for bad in ("m", "", None, "fortnight"):
        with pytest.raises(ValueError):
            timefn.period_of(bad)


def test_period_column_agrees(spark):
    words = [word for group in timefn.PERIOD_WORDS.values() for word in group]
    rows = spark.createDataFrame([(word,) for word in words + ["m"]], "w string").select("w", timefn.period_column(F.col("w")).alias("p")).collect()
    assert {row["w"]: row["p"] for row in rows} == {**{word: timefn.period_of(word) for word in words}, "m": None}


def test_durations():
    assert timefn.span_of("10 days") == timefn.Span(10, "day")
    assert timefn.span_of("2 months") == timefn.Span(2, "month")
    assert timefn.span_of("3secs") == timefn.Span(3, "second")
    assert timefn.Span(1, "month").shift(dt.datetime(2024, 1, 31)) == dt.datetime(2024, 2, 29)
    assert timefn.Span(2, "month").shift(dt.datetime(2024, 1, 31), -1) == dt.datetime(2023, 11, 30)
    assert timefn.Span(1, "year").shift(dt.datetime(2024, 2, 29)) == dt.datetime(2025, 2, 28)
    assert timefn.Span(1, "month").shift(dt.datetime(2024, 12, 15)) == dt.datetime(2025, 1, 15)
    with pytest.raises(ValueError):
        timefn.span_of("864000")


def test_moments():
    assert timefn.moment_of("2 days ago", NOW) == dt.datetime(2015, 6, 10, 2)
    assert timefn.past_reflected("10 days", NOW) == dt.datetime(2015, 6, 2, 2)
    assert timefn.past_reflected("2015-01-01T00:00:00Z", NOW) == dt.datetime(2015, 1, 1)
    with pytest.raises(ValueError):
        timefn.moment_of("next blue moon", NOW)


SUFFIXES = {
    "second": "2012.11.14.13:49:48", "minute": "2012.11.14.13:49", "hour": "2012.11.14.13", "day": "2012.11.14", "month": "2012.11", "year": "2012",
}


def test_suffixes(spark):
    one = spark.range(1).select(F.lit("2012-11-14 13:49:48").cast("timestamp_ntz").alias("t"), F.lit("2012-05-13").cast("timestamp_ntz").alias("sunday"))
    row = one.select(*[timefn.dated_suffix(F.col("t"), name).alias(name) for name in SUFFIXES], timefn.dated_suffix(F.col("sunday"), "week").alias("week")).first()
    assert row.asDict() == {**SUFFIXES, "week": "2012-20"}
    assert timefn.suffix_format("second", lowest="day") == "yyyy.MM.dd" and timefn.suffix_format("month", lowest="day") == "yyyy.MM"


def test_suffixes_read_back(spark):
    texts = [*SUFFIXES.values(), "2012-20", "fail", "2012.13", "2012-54", "2012.11.14.25"]
    rows = spark.createDataFrame([(text,) for text in texts], "s string").select("s", timefn.suffix_start(F.col("s")).alias("t"), timefn.suffix_period(F.col("s")).alias("p")).collect()
    found = {row["s"]: row["t"] for row in rows}
    assert found["2012.11.14.13:49:48"] == dt.datetime(2012, 11, 14, 13, 49, 48)
    assert found["2012-20"] == dt.datetime(2012, 5, 13) and found["2012"] == dt.datetime(2012, 1, 1)
    assert [found[text] for text in ("fail", "2012.13", "2012-54", "2012.11.14.25")] == [None] * 4


def test_weeks_over_year_ends(spark):
    days = [dt.datetime(2010, 1, 1) + dt.timedelta(days=n) for n in range(0, 3000)]
    rows = spark.createDataFrame([(day,) for day in days], "d timestamp_ntz").select("d", timefn.week_suffix(F.col("d")).alias("w"))
    rows = rows.withColumn("back", timefn.suffix_start(F.col("w"))).collect()
    for row in rows:
        sunday = row["d"] - dt.timedelta(days=(row["d"].weekday() + 1) % 7)
        assert row["back"] == sunday
        year = (sunday + dt.timedelta(days=6)).year
        assert row["w"].startswith(f"{year}-")


def test_flexible_timestamps(spark):
    rows = spark.createDataFrame([("2015-10-16T18:19:26.566",), ("2015-10-16T18:19:26.566Z",), ("today",), (None,)], "s string")
    got = [row[0] for row in rows.select(timefn.flexible_timestamp(F.col("s"), "string")).collect()]
    assert got == [dt.datetime(2015, 10, 16, 18, 19, 26, 566000)] * 2 + [None, None]
    number = spark.range(1).select(timefn.flexible_timestamp(F.lit(1445019566566), "bigint")).first()[0]
    assert number == got[0]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_micros_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.range(1).select(timefn.micros(F.lit("2024-07-01 12:00:00.000123").cast("timestamp_ntz")).alias("m"))
        back = row.select("m", timefn.from_micros(F.col("m")).alias("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert back["m"] == 1719835200000123 and back["t"] == dt.datetime(2024, 7, 1, 12, 0, 0, 123)


UNTIMED = ["fail1", "fail2_notdate", "fail2_segment_10"]
DAY = dt.timedelta(days=1)
TIMED = {
    "works_2015/": (dt.datetime(2015, 1, 1), dt.datetime(2016, 1, 1)),
    "works_2015_100": (dt.datetime(2015, 1, 1), dt.datetime(2016, 1, 1)),
    "works_2015.01": (dt.datetime(2015, 1, 1), dt.datetime(2015, 2, 1)),
    "works_2015.01.01": (dt.datetime(2015, 1, 1), dt.datetime(2015, 1, 2)),
    "works_2015.01.01.01": (dt.datetime(2015, 1, 1, 1), dt.datetime(2015, 1, 1, 2)),
    "works_2015-10": (dt.datetime(2015, 3, 1), dt.datetime(2015, 3, 8)),
    "works/2015-10": (dt.datetime(2015, 3, 1), dt.datetime(2015, 3, 8)),
    "works_test/2015-10": (dt.datetime(2015, 3, 1), dt.datetime(2015, 3, 8)),
    "2015.01": (dt.datetime(2015, 1, 1), dt.datetime(2015, 2, 1)),
    "2015-10": (dt.datetime(2015, 3, 1), dt.datetime(2015, 3, 8)),
}


def test_directories(spark):
    listing = spark.createDataFrame([(path,) for path in [*UNTIMED, *TIMED]], "path string")
    assert {row["path"] for row in timeslice.untimed_directories(listing).collect()} == set(UNTIMED)
    assert {row["path"]: (row["start"], row["end"]) for row in timeslice.timed_directories(listing).collect()} == TIMED


@pytest.mark.parametrize(
    "low,high,kept",
    [
        (None, None, {"works_2015.06.01", "works_2015.06.03", "works_2015.01.01.01_100", "works_2035.01.01.01"}),
        ("10 days", None, {"works_2015.06.03", "works_2035.01.01.01"}),
        (None, "10 days", {"works_2015.06.01", "works_2015.01.01.01_100"}),
        ("12 days", "8 days", {"works_2015.06.01", "works_2015.06.03"}),
    ],
)
def test_pruned_directories(spark, low, high, kept):
    names = ["works_2015.06.01", "works_2015.06.03", "works_2015.01.01.01_100", "works_2035.01.01.01"]
    listing = spark.createDataFrame([(name,) for name in names], "path string")
    found = timeslice.prune_directories(listing, *timeslice.time_range(low, high, NOW))
    assert {row["path"] for row in found.collect()} == kept


def test_bad_range_raises():
    with pytest.raises(ValueError):
        timeslice.time_range("whenever", None, NOW)


def test_slice_policies(spark):
    rows = [(1, dt.datetime(2015, 1, 31, 23)), (2, dt.datetime(2015, 2, 1, 1)), (3, None)]
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz")
    got = lambda **kw: [row["__slice"] for row in timeslice.with_slice(df, "t", "month", **kw).orderBy("id").collect()]
    assert got(policy="record") == ["2015.01", "2015.02", "all_time"]
    assert got(policy="clock_time", now=NOW) == ["2015.06"] * 3
    assert got(policy="batch", order=["id"]) == ["2015.01"] * 3
