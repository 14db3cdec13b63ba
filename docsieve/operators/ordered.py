"""Ordered per-key work in which no key is tied to one task.

A window over one key runs in one task. Here the rows of a large key are cut into chunks of consecutive rows: splitters come from a sample
of bounded size that the plan itself draws, and a row's chunk is a column, the number of its key's splitters at or below it. Each (key,
chunk) runs its own window, those of a cut key give one summary row each, the summaries are scanned in order, and what a chunk inherits is
added to its rows. One path serves every key, size and orderable type. Building a plan runs no job and writes nothing; the rows are
shuffled once, and not at all between windows. Ties beyond the given order are in no defined order, as in any window.

The sample is a function of the rows (the least hash in each of ``SAMPLE`` buckets), so every part of the plan and every task run again
sees the same chunks, as long as ``df`` gives the same rows each time it is read: write it first if it does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "__chunk"
CUT = "__cut"  # true for the rows of keys that lie in several chunks
SAMPLE = 1 << 15  # rows the splitters come from, at most; so there are at most as many chunks beyond the first of each key
CHUNK_ROWS = 1_000_000  # rows of one key that one task takes, unless the sample is too small for chunks that short


@dataclass(frozen=True)
class Running:
    """A value carried along a key's rows: ``count``, ``sum``, ``min``, ``max`` or ``previous`` (last non-null before)."""

    kind: str
    value: Column | None = None

    def within(self, keys: list[str], order: list[str]) -> Column:
        window = Window.partitionBy(*keys).orderBy(*order)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.kind == "count":
            return F.count(F.lit(1)).over(upto)
        if self.kind == "sum":
            return F.coalesce(F.sum(self.value).over(upto), F.lit(0.0))
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(self.value).over(upto)
        return F.last(self.value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))

    def summary(self, order: list[str]) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1))
        if self.kind in ("sum", "min", "max"):
            return getattr(F, self.kind)(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))

    def inherited(self, name: str, keys: list[str]) -> Column:
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        if self.kind in ("count", "sum"):
            return F.sum(name).over(before)
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(name).over(before)
        return F.last(name, ignorenulls=True).over(before)

    def joined(self, inside: Column, carried: Column) -> Column:
        if self.kind in ("count", "sum"):
            return inside + F.coalesce(carried, F.lit(0))
        if self.kind in ("min", "max"):
            return getattr(F, "least" if self.kind == "min" else "greatest")(inside, carried)
        return F.coalesce(inside, carried)


def _splitters(df: DataFrame, names: list[str], order: list[str], chunks: int | None) -> DataFrame:
    """One row per key that needs several chunks: (keys, ``__splits``), the first rows of all its chunks but the first, in order."""
    spot = F.xxhash64(*names, *order)
    drawn = df.select(spot.alias("__h")).groupBy(F.pmod("__h", F.lit(SAMPLE)).alias("__b"))
    drawn = drawn.agg(F.min("__h").alias("__h"), F.count(F.lit(1)).alias("__n")).drop("__b")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # SAMPLE rows at most
    totals = drawn.select("__h", F.sum("__n").over(everything).alias("__rows"), F.count(F.lit(1)).over(everything).alias("__drawn"))
    rows = df.select(*names, F.struct(*order).alias("__at"), spot.alias("__h")).join(F.broadcast(totals), "__h")
    step = F.greatest(F.lit(1), F.floor(F.lit(CHUNK_ROWS) * F.col("__drawn") / F.col("__rows")))
    if chunks:
        step = F.ceil(F.col("__drawn") / chunks)
    # a set, since rows that are equal in key and order are drawn together
    kept = rows.groupBy(*names).agg(F.array_sort(F.collect_set("__at")).alias("__all"), F.max(step).alias("__step"))
    splits = F.filter("__all", lambda _, place: (place > 0) & (place % F.col("__step") == 0))
    return kept.select(*names, splits.alias("__splits")).filter(F.size("__splits") > 0)


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``df`` with ``__chunk``, the number of a row's chunk within its key, and ``__cut``, whether its key has several.

    Chunks of a key are consecutive in ``order`` (ascending, nulls first), and rows that tie in all of it share one. A chunk has about
    ``CHUNK_ROWS`` rows, or the table's share per sampled row where that is more; ``chunks`` cuts the whole table into about that many
    instead. Where rows are cut changes where work runs, never the result.
    """
    if not order:
        raise ValueError("an explicit order is required")
    names, order = list(keys), list(order)
    splitters = _splitters(df, names, order, chunks)
    if names:
        both = null_safe_join(df, F.broadcast(splitters), names, "left")
    else:
        both = df.withColumn("__splits", splitters.scalar())
    here = F.struct(*order)
    halves = F.array(*[F.lit(1 << bit) for bit in reversed(range(SAMPLE.bit_length()))])
    # binary search: go on by ever smaller steps while the splitter there is at or below the row
    below = F.aggregate(
        halves, F.lit(0), lambda done, by: F.when(F.get("__splits", done + by - 1) <= here, done + by).otherwise(done)
    )
    cut = F.col("__splits").isNotNull()
    return both.withColumns({CHUNK: F.when(cut, below).otherwise(0), CUT: cut}).drop("__splits")


def null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Join in which nulls of the key are equal; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({name: f"__r_{name}" for name in names})
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"`{name}`").eqNullSafe(F.col(f"`__r_{name}`"))
    joined = left.join(renamed, condition, how)
    return joined if how == "left_semi" else joined.drop(*[f"__r_{name}" for name in names])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Running], chunks: int | None = None) -> DataFrame:
    """Add running columns per key in ``order`` (ascending, nulls first).

    Keys and order are columns of ``df`` of any orderable type; rows that tie in all of ``order`` come in no defined order.
    """
    names, order = list(keys), list(order)
    cut = in_chunks(df, names, order, chunks)
    group = [*names, CHUNK]
    inside = cut.withColumns({name: value.within(group, order) for name, value in values.items()})
    partial = cut.filter(CUT).groupBy(*group).agg(*[value.summary(order).alias(name) for name, value in values.items()])
    # at most two rows per splitter, so their number is bounded by the sample
    carried = partial.select(*group, *[value.inherited(name, names).alias(f"__c_{name}") for name, value in values.items()])
    both = null_safe_join(inside, F.broadcast(carried), group, "left")
    out = both.withColumns({name: value.joined(F.col(name), F.col(f"__c_{name}")) for name, value in values.items()})
    return out.select(*[F.col(f"`{name}`") for name in df.columns], *values)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int = 1) -> DataFrame:
    """First ``rows`` rows per key. Spark limits each map task to that many rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= rows).drop("__rank")
