"""Periods, durations, dated suffixes and flexible timestamps.

Timestamps are ``timestamp_ntz`` read as UTC throughout, so results do not depend on the session time zone.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# fixed values: words accepted for each period ("m" alone is ambiguous and refused)
PERIOD_WORDS = {
    "second": ("1sec", "sec", "1s", "s", "1second", "second"),
    "minute": ("1min", "min", "1minute", "minute"),
    "hour": ("1h", "h", "1hour", "hour", "hourly"),
    "day": ("1d", "d", "1day", "day", "daily"),
    "week": ("1w", "w", "1wk", "wk", "1week", "week", "weekly"),
    "month": ("1month", "month", "monthly"),
    "year": ("1y", "y", "1year", "year", "1yr", "yr", "yearly"),
}

# fixed values: dated suffix of each period, finest first
SUFFIX_FORMATS = {
    "second": "yyyy.MM.dd.HH:mm:ss",
    "minute": "yyyy.MM.dd.HH:mm",
    "hour": "yyyy.MM.dd.HH",
    "day": "yyyy.MM.dd",
    "week": "YYYY-ww",
    "month": "yyyy.MM",
    "year": "yyyy",
}
# fixed values: the shape of each suffix
SUFFIX_SHAPES = {
    "second": r"[0-9]{4}[.][0-9]{2}[.][0-9]{2}[.][0-9]{2}:[0-9]{2}:[0-9]{2}",
    "minute": r"[0-9]{4}[.][0-9]{2}[.][0-9]{2}[.][0-9]{2}:[0-9]{2}",
    "hour": r"[0-9]{4}[.][0-9]{2}[.][0-9]{2}[.][0-9]{2}",
    "day": r"[0-9]{4}[.][0-9]{2}[.][0-9]{2}",
    "week": r"[0-9]{4}-[0-9]{2}",
    "month": r"[0-9]{4}[.][0-9]{2}",
    "year": r"[0-9]{4}",
}
PERIODS = tuple(SUFFIX_FORMATS)

_INTERVALS = {period: f"INTERVAL 1 {period.upper()}" for period in PERIODS}


def period_of(text: str | None) -> str:
    """Period named by a word such as ``daily`` or ``1d``; raises ValueError otherwise."""
    word = re.sub(r"\s+", "", (text or "").lower())
    for period, words in PERIOD_WORDS.items():
        if word in words:
            return period
    raise ValueError(f"not a time period: {text!r}")


def period_column(text: Column) -> Column:
    """``period_of`` for a column; null where the text names no period."""
    word = F.regexp_replace(F.lower(text), r"\s+", "")
    chain = None
    for period, words in PERIOD_WORDS.items():
        hit = word.isin(list(words))
        chain = F.when(hit, period) if chain is None else chain.when(hit, period)
    return chain


@dataclass(frozen=True)
class Span:
    """A calendar amount, e.g. 3 months."""

    amount: int
    period: str

    def column(self) -> Column:
        return F.expr(f"INTERVAL {self.amount} {self.period.upper()}")

    def shift(self, moment: dt.datetime, sign: int = 1) -> dt.datetime:
        amount = sign * self.amount
        if self.period in ("month", "year"):
            months = moment.year * 12 + moment.month - 1 + amount * (12 if self.period == "year" else 1)
            year, month = divmod(months, 12)
            first_next = dt.datetime(year + (month == 11), (month + 1) % 12 + 1, 1)
            last_day = (first_next - dt.timedelta(days=1)).day
            return moment.replace(year=year, month=month + 1, day=min(moment.day, last_day))
        return moment + dt.timedelta(**{self.period + "s": amount})


def span_of(text: str) -> Span:
    """Duration text: a period word, or ``<N> <unit>``; calendar arithmetic for both."""
    try:
        return Span(1, period_of(text))
    except ValueError:
        pass
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", text or "", re.I)
    if match:
        unit = match.group(2).lower()
        for candidate in (unit, unit[:-1] if unit.endswith("s") else unit):
            try:
                return Span(int(match.group(1)), period_of(candidate))
            except ValueError:
                continue
    raise ValueError(f"not a duration: {text!r}")


def moment_of(text: str, now: dt.datetime) -> dt.datetime:
    """Subset of date phrases: ``now``, ``<N> unit``, ``<N> unit ago``, ISO dates."""
    phrase = (text or "").strip().lower()
    if phrase == "now":
        return now
    if phrase.endswith(" ago"):
        return span_of(phrase[:-4]).shift(now, -1)
    try:
        return span_of(phrase).shift(now)
    except ValueError:
        parsed = dt.datetime.fromisoformat(phrase.upper().removesuffix("Z"))
        return parsed.replace(tzinfo=None)


def past_reflected(text: str, now: dt.datetime) -> dt.datetime:
    """A moment that lies ahead of ``now`` is mirrored into the past, so ``10 days`` means ten days ago."""
    moment = moment_of(text, now)
    return now - (moment - now) if moment > now else moment


def past_reflected_column(moment: Column, now: Column) -> Column:
    """Column form of ``past_reflected`` on microseconds."""
    at, ref = micros(moment), micros(now)
    return from_micros(F.when(at > ref, ref - (at - ref)).otherwise(at))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a ``timestamp_ntz`` read as UTC (whatever the session time zone)."""
    at = ts.cast("timestamp_ntz")
    minutes = (F.unix_date(at.cast("date")).cast("bigint") * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * F.lit(60_000_000).cast("bigint") + (F.date_part(F.lit("SECONDS"), at) * 1_000_000).cast("bigint")


def from_micros(value: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", value.cast("bigint"), epoch)


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / F.lit(1000)).cast("bigint")


def flexible_timestamp(value: Column, dtype: str) -> Column:
    """``timestamp_ntz`` of a number (epoch millis) or of ISO text with or without ``Z``; null when neither.

    ``dtype`` is the Spark type name of the column, so only the branch that applies is compiled.
    """
    if dtype in ("timestamp_ntz", "date"):
        return value.cast("timestamp_ntz")
    if dtype == "timestamp":
        return from_micros(F.unix_micros(value))
    if dtype == "string":
        iso = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z?$")
        return F.when(iso, F.regexp_replace(value, "Z$", "").try_cast("timestamp_ntz"))
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return from_micros(value.cast("bigint") * 1000)
    return F.lit(None).cast("timestamp_ntz")


def suffix_format(period: str, lowest: str | None = None) -> str:
    """Format of the dated suffix, coarsened to ``lowest`` when the period is finer than that."""
    if lowest is not None and PERIODS.index(period) < PERIODS.index(lowest):
        period = lowest
    return SUFFIX_FORMATS[period]


def _week_start(day: Column) -> Column:
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_suffix(ts: Column) -> Column:
    """``year-week`` with weeks from Sunday, week 1 being the one that holds January 1."""
    start = _week_start(ts.cast("date"))
    year = F.year(F.date_add(start, 6))
    first = _week_start(F.make_date(year, F.lit(1), F.lit(1)))
    number = (F.datediff(start, first) / 7 + 1).cast("int")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(number.cast("string"), 2, "0"))


def dated_suffix(ts: Column, period: str, lowest: str | None = None) -> Column:
    """Dated suffix of a timestamp for a period."""
    fmt = suffix_format(period, lowest)
    return week_suffix(ts) if fmt == "YYYY-ww" else F.date_format(ts, fmt)


def suffix_period(suffix: Column) -> Column:
    """Period whose suffix shape the text has, else null."""
    chain = None
    for period, shape in SUFFIX_SHAPES.items():
        hit = suffix.rlike(f"^{shape}$")
        chain = F.when(hit, period) if chain is None else chain.when(hit, period)
    return chain


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def suffix_start(suffix: Column) -> Column:
    """First instant of a dated suffix, strictly parsed; null when it is none."""

    def read(text: Column) -> Column:
        def part(start: int, length: int, default: str) -> Column:
            digits = F.substring(text, start, length)
            return F.when(digits == "", F.lit(default)).otherwise(digits)

        stamp = F.concat(
            part(1, 4, "0000"), F.lit("-"), part(6, 2, "01"), F.lit("-"), part(9, 2, "01"), F.lit(" "),
            part(12, 2, "00"), F.lit(":"), part(15, 2, "00"), F.lit(":"), part(18, 2, "00"),
        )
        year = F.substring(text, 1, 4).try_cast("int")
        week = F.substring(text, 6, 2).try_cast("int")
        first = let(F.make_date(year, F.lit(1), F.lit(1)), _week_start)
        of_week = F.when(week.between(1, 53), F.date_add(first, (week - 1) * 7).cast("timestamp_ntz"))
        return let(
            suffix_period(text),
            lambda shape: F.when(shape == "week", of_week).when(shape.isNotNull(), stamp.try_cast("timestamp_ntz")),
        )

    return let(suffix, read)


def plus_period(ts: Column, period: Column) -> Column:
    """One period later, where the period is itself a column."""
    chain = None
    for name, interval in _INTERVALS.items():
        later = ts + F.expr(interval)
        chain = F.when(period == name, later) if chain is None else chain.when(period == name, later)
    return chain


def directory_suffix(path: Column) -> Column:
    """Dated part of a directory name: the last path part, a segment of up to three characters cut, after the last ``_``."""
    name = F.element_at(F.split(F.regexp_replace(path, "/$", ""), "/"), -1)
    whole = F.regexp_replace(name, "_[^_]{0,3}$", "")
    return F.element_at(F.split(whole, "_"), -1)


def directory_span(path: Column) -> Column:
    """(start, end) of a dated directory; both null when the name carries no date."""

    def span(suffix: Column) -> Column:
        return let(
            suffix_start(suffix),
            lambda start: F.struct(start.alias("start"), plus_period(start, suffix_period(suffix)).alias("end")),
        )

    return let(directory_suffix(path), span)
