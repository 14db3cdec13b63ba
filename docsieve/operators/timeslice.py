"""Time slices: dated directories, sliced scans, retention and tiers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docsieve.functions import timefn
from docsieve.operators.query import Query, any_of

SLICE = "__slice"


def annotate_directories(listing: DataFrame, path: str = "path") -> DataFrame:
    """Listing with ``start`` and ``end`` of each dated directory (null for untimed ones)."""
    span = timefn.directory_span(F.col(path))
    return listing.withColumn("__span", span).select(*listing.columns, F.col("__span.start").alias("start"), F.col("__span.end").alias("end"))


def timed_directories(listing: DataFrame, path: str = "path") -> DataFrame:
    return annotate_directories(listing, path).filter(F.col("start").isNotNull())


def untimed_directories(listing: DataFrame, path: str = "path") -> DataFrame:
    return annotate_directories(listing, path).filter(F.col("start").isNull()).drop("start", "end")


def overlaps(start: Column, end: Column, low: Column | None, high: Column | None) -> Column:
    """A slice is kept when the lower bound is before its end and the upper bound is not before its start."""
    test = F.lit(True)
    if low is not None:
        test = test & (low < end)
    if high is not None:
        test = test & (high >= start)
    return test


def time_range(time_min: str | None, time_max: str | None, now: dt.datetime) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Bounds of a scan from relative phrases; phrases ahead of ``now`` are mirrored into the past. Bad text raises."""
    low = timefn.past_reflected(time_min, now) if time_min else None
    high = timefn.past_reflected(time_max, now) if time_max else None
    return low, high


def prune_directories(
    listing: DataFrame, low: dt.datetime | None, high: dt.datetime | None, path: str = "path", keep_untimed: bool = False
) -> DataFrame:
    """Directories a scan over ``[low, high]`` has to read."""
    spans = annotate_directories(listing, path)
    bound = lambda moment: None if moment is None else F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    test = F.col("start").isNotNull() & overlaps(F.col("start"), F.col("end"), bound(low), bound(high))
    if keep_untimed:
        test = test | F.col("start").isNull()
    return spans.filter(test).drop("start", "end")


def slice_column(ts: Column, period: str, policy: str = "record", now: dt.datetime | None = None) -> Column:
    """Slice a row is stored in: by its own time (``record``) or by the clock (``clock_time``)."""
    if policy == "clock_time":
        clock = F.lit((now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).isoformat(sep=" ")).cast("timestamp_ntz")
        return timefn.dated_suffix(clock, period)
    if policy != "record":
        raise ValueError("the batch policy needs with_slice")
    return F.coalesce(timefn.dated_suffix(ts, period), F.lit("all_time"))


def with_slice(
    df: DataFrame, ts: str, period: str, policy: str = "record", batch: Sequence[str] = (), order: Sequence[str] = (), now: dt.datetime | None = None
) -> DataFrame:
    """Add ``__slice``. Policy ``batch`` puts a whole write batch into the slice of its first row's time.

    ``batch`` names the columns telling batches apart (none: the frame is one batch, as in a micro-batch), ``order`` the arrival
    order that says which row is first.
    """
    if policy != "batch":
        return df.withColumn(SLICE, slice_column(F.col(ts), period, policy, now))
    first = F.min_by(F.col(ts), F.struct(*order)) if order else F.min(ts)
    if not batch:
        moment = df.agg(first.alias("t")).scalar()
        return df.withColumn(SLICE, F.coalesce(timefn.dated_suffix(moment, period), F.lit("all_time")))
    firsts = df.groupBy(*batch).agg(first.alias("__first"))
    joined = df.join(firsts, list(batch))
    return joined.withColumn(SLICE, F.coalesce(timefn.dated_suffix(F.col("__first"), period), F.lit("all_time"))).drop("__first")


def slice_bounds(period: str, low: dt.datetime | None, high: dt.datetime | None, slice_name: str = SLICE) -> Column:
    """Predicate on the slice column alone. Suffixes of one period sort like time, so Spark prunes partitions by it.

    Rows without a time (``all_time``) are in no range, whichever bound is given; without bounds they stay.
    """
    test = F.lit(True) if low is None and high is None else F.col(slice_name) != "all_time"
    stamp = lambda moment: timefn.dated_suffix(F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz"), period)
    if low is not None:
        test = test & (F.col(slice_name) >= stamp(low))
    if high is not None:
        test = test & (F.col(slice_name) <= stamp(high))
    return test


def sliced_scan(
    df: DataFrame, ts: str, period: str, low: dt.datetime | None = None, high: dt.datetime | None = None, exact: bool = False
) -> DataFrame:
    """Rows of the slices that overlap ``[low, high]``; ``exact`` also tests every row."""
    out = df.filter(slice_bounds(period, low, high))
    if exact:
        bound = lambda moment: F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
        if low is not None:
            out = out.filter(F.col(ts) >= bound(low))
        if high is not None:
            out = out.filter(F.col(ts) <= bound(high))
    return out


def age_out(df: DataFrame, ts: str, max_age: str, now: dt.datetime, period: str | None = None) -> DataFrame:
    """Rows not older than ``max_age``; with ``period`` whole expired slices are pruned before any row is read."""
    cutoff = timefn.span_of(max_age).shift(now, -1)
    out = df
    if period is not None and SLICE in df.columns:
        out = out.filter((F.col(SLICE) == "all_time") | slice_bounds(period, cutoff, None))
    return out.filter(F.col(ts).isNull() | (F.col(ts) >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")))


def expired_slices(listing: DataFrame, max_age: str, now: dt.datetime, path: str = "path") -> DataFrame:
    """Directories whose whole span ends at or before the cutoff."""
    cutoff = F.lit(timefn.span_of(max_age).shift(now, -1).isoformat(sep=" ")).cast("timestamp_ntz")
    return timed_directories(listing, path).filter(F.col("end") <= cutoff)


def tier(ts: Column, now: dt.datetime, ages: Mapping[str, str], oldest: str = "expired") -> Column:
    """Storage tier by age: ``ages`` maps tier to the age it lasts to, youngest first."""
    chain = None
    for name, age in ages.items():
        cutoff = F.lit(timefn.span_of(age).shift(now, -1).isoformat(sep=" ")).cast("timestamp_ntz")
        hit = ts >= cutoff
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(oldest)


def age_out_needed(fields: Sequence[str]) -> Query:
    """Catalog rows in which any age limit is present."""
    query = any_of()
    for name in fields:
        query = query.with_present(name)
    return query
