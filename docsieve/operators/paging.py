"""Cursors over sorted unions: each page goes on behind the last row of the page before, so no earlier row is sorted again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, functions as F

from docsieve.operators.buckets import BUCKET

Order = Sequence[tuple[str, int]]


def _sorted(order: Order) -> list[Column]:
    return [F.col(f"`{name}`").asc_nulls_first() if sign > 0 else F.col(f"`{name}`").desc_nulls_last() for name, sign in order]


def _typed(df: DataFrame, name: str, value: Any) -> Column:
    return F.lit(value).cast(df.schema[name].dataType)


def _behind(df: DataFrame, name: str, sign: int, value: Any, strict: bool) -> Column:
    """Rows whose column comes after ``value`` (or ties with it): ascending with nulls first, descending with nulls last."""
    column = F.col(f"`{name}`")
    if value is None:
        if sign > 0:
            return column.isNotNull() if strict else F.lit(True)
        return F.lit(False) if strict else column.isNull()
    bound = _typed(df, name, value)
    if sign > 0:
        return column > bound if strict else column >= bound
    return (column < bound if strict else column <= bound) | column.isNull()


def behind(df: DataFrame, order: Order, cursor: Mapping[str, Any]) -> Column:
    """True for rows that sort behind ``cursor``, which holds a value (or None) per column of ``order``.

    The bound on the first column stands alone in front, so that it reaches the scan as a pushed filter.
    """
    missing = [name for name, _ in order if name not in cursor]
    if missing:
        raise ValueError(f"the cursor lacks {missing}")
    terms = []
    for at, (name, sign) in enumerate(order):
        ties = [F.col(f"`{other}`").eqNullSafe(_typed(df, other, cursor[other])) for other, _ in order[:at]]
        terms.append(reduce(lambda a, b: a & b, ties, _behind(df, name, sign, cursor[name], strict=True)))
    exact = F.coalesce(reduce(lambda a, b: a | b, terms), F.lit(False))
    name, sign = order[0]
    return _behind(df, name, sign, cursor[name], strict=False) & exact


def page(
    buckets: Mapping[str, DataFrame], order: Order, size: int, unique: str, cursor: Mapping[str, Any] | None = None
) -> DataFrame:
    """The next ``size`` rows of all buckets in ``order``, behind ``cursor`` (None: from the start), with ``__bucket``.

    Ties are broken by bucket name and by ``unique``, a column that identifies a row in its bucket, never null. Per bucket a range
    predicate cuts off what was read and each task keeps its own first ``size`` rows; only the buckets' first rows meet. ``order`` may be empty;
    nulls come first ascending and last descending. An empty bucket adds nothing; a column some buckets lack is null there.
    """
    if not buckets:
        raise LookupError("no bucket to read")
    if size < 1:
        raise ValueError("a page holds at least one row")
    names = [name for name, _ in order]
    if len({*names, BUCKET, unique}) < len(names) + 2:
        raise ValueError("each column once; the bucket and the unique column come last by themselves")
    whole = [*order, (BUCKET, 1), (unique, 1)]
    types = {}
    for df in buckets.values():
        for field in df.schema.fields:
            types.setdefault(field.name, field.dataType)
    tops = []
    for name in sorted(buckets):
        df = buckets[name].withColumn(BUCKET, F.lit(name))
        for column in names:
            if column not in df.columns:
                df = df.withColumn(column, F.lit(None).cast(types[column]))
        if cursor is not None:
            df = df.filter(behind(df, whole, cursor))
        tops.append(df.orderBy(*_sorted(whole)).limit(size))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tops)
    return union.orderBy(*_sorted(whole)).limit(size)


def cursor_of(last: Row, order: Order, unique: str) -> dict[str, Any]:
    """Cursor behind the last row of a page: plain values, to be kept by the caller between requests."""
    return {name: last[name] for name in [*[name for name, _ in order], BUCKET, unique]}


def last_row(rows: DataFrame, order: Order, unique: str) -> Row | None:
    """Last row of a page in its order, one row; None if the page is empty."""
    backwards = [F.col(f"`{n}`").desc_nulls_last() if s > 0 else F.col(f"`{n}`").asc_nulls_first() for n, s in [*order, (BUCKET, 1), (unique, 1)]]
    return rows.orderBy(*backwards).first()
