"""Query algebra: predicates, boolean trees, sort, limit and projection compiled to one Spark ``Column``.

``all_of()`` and ``any_of()`` start a query; calls chain. ``Query.column(schema)`` gives the predicate, ``Query.apply(df)``
runs filter, order, limit and projection, so Catalyst sees ordinary operators and can push the filter to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docsieve.functions import paths

Order = tuple[str, int]


def _literal(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _same(column: Column, dtype: T.DataType, value: Any) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.array_contains(column, _literal(value))
    return column == _literal(value)


def _compare(column: Column, dtype: T.DataType, test) -> Column:
    return F.exists(column, test) if isinstance(dtype, T.ArrayType) else test(column)


@dataclass(frozen=True)
class Term:
    """One leaf: an operator on a dotted field."""

    kind: str
    field: str
    args: tuple = ()

    def column(self, schema: T.StructType) -> Column:
        return self.test(*paths.query_path(schema, self.field))

    def test(self, column: Column, dtype: T.DataType) -> Column:
        """The operator on a column of the given type; both bounds of a range belong to this one test."""
        is_array = isinstance(dtype, T.ArrayType)
        if self.kind == "present":
            return column.isNotNull()
        if self.kind == "absent":
            return column.isNull()
        if isinstance(dtype, T.NullType):
            # the schema has no such field: nothing equals it, "not equal" holds
            return F.lit(self.kind == "not" or (self.kind == "range" and self.args[0] is None and self.args[2] is None))
        if self.kind == "is":
            return _same(column, dtype, self.args[0])
        if self.kind == "not":
            value = self.args[0]
            if is_array:
                return ~F.coalesce(F.array_contains(column, _literal(value)), F.lit(False))
            return ~column.eqNullSafe(_literal(value))
        if self.kind == "any":
            values = list(self.args[0])
            if not values:
                return F.lit(False)
            return F.arrays_overlap(column, F.array(*map(_literal, values))) if is_array else column.isin(values)
        if self.kind == "all":
            values = list(self.args[0])
            if is_array:
                return F.size(F.array_except(F.array(*map(_literal, values)), column)) == 0
            return reduce(lambda a, b: a & b, [column == _literal(value) for value in values], F.lit(True))
        low, low_open, high, high_open = self.args
        terms = []
        if low is not None:
            bound = _literal(low)
            terms.append(_compare(column, dtype, (lambda x: x > bound) if low_open else (lambda x: x >= bound)))
        if high is not None:
            limit = _literal(high)
            terms.append(_compare(column, dtype, (lambda x: x < limit) if high_open else (lambda x: x <= limit)))
        return reduce(lambda a, b: a & b, terms, F.lit(True))


@dataclass(frozen=True)
class Query:
    """A boolean tree of terms with the sort, limit and projection of its outermost node."""

    joiner: str = "all"
    terms: tuple[Term, ...] = ()
    children: tuple["Query", ...] = ()
    order: tuple[Order, ...] = ()
    row_limit: int | None = None
    row_offset: int | None = None
    fields: tuple[str, ...] = ()
    include: bool = True

    # leaves -------------------------------------------------------------------------------------------------------
    def _with(self, *terms: Term) -> "Query":
        return replace(self, terms=self.terms + terms)

    def when(self, name: str, value: Any) -> "Query":
        return self._with(Term("is", name, (value,)))

    def when_not(self, name: str, value: Any) -> "Query":
        return self._with(Term("not", name, (value,)))

    def with_any(self, name: str, values: Iterable[Any]) -> "Query":
        return self._with(Term("any", name, (tuple(values),)))

    def with_all(self, name: str, values: Iterable[Any]) -> "Query":
        return self._with(Term("all", name, (tuple(values),)))

    def with_present(self, name: str) -> "Query":
        return self._with(Term("present", name))

    def with_not_present(self, name: str) -> "Query":
        return self._with(Term("absent", name))

    def range_above(self, name: str, low: Any, exclusive: bool = False) -> "Query":
        return self._with(Term("range", name, (low, exclusive, None, False)))

    def range_below(self, name: str, high: Any, exclusive: bool = False) -> "Query":
        return self._with(Term("range", name, (None, False, high, exclusive)))

    def range_in(self, name: str, low: Any, low_exclusive: bool, high: Any, high_exclusive: bool) -> "Query":
        return self._with(Term("range", name, (low, low_exclusive, high, high_exclusive)))

    def nested(self, name: str, query: "Query") -> "Query":
        """Terms and sub-queries of ``query`` under ``name.``; its own joiner, order and limit do not carry over, those of sub-queries' terms do."""

        def under(part: "Query") -> "Query":
            terms = tuple(replace(term, field=f"{name}.{term.field}") for term in part.terms)
            return replace(part, terms=terms, children=tuple(under(child) for child in part.children))

        inner = under(query)
        return self._with(*inner.terms).also(*inner.children)

    def also(self, *queries: "Query") -> "Query":
        return replace(self, children=self.children + queries)

    # sort, limit, projection --------------------------------------------------------------------------------------
    def order_by(self, *orders: Order) -> "Query":
        return replace(self, order=self.order + orders)

    def limit(self, rows: int) -> "Query":
        return replace(self, row_limit=rows)

    def skip(self, rows: int) -> "Query":
        return replace(self, row_offset=rows)

    def only(self, *names: str) -> "Query":
        return replace(self, fields=names, include=True)

    def without(self, *names: str) -> "Query":
        return replace(self, fields=names, include=False)

    # compilation --------------------------------------------------------------------------------------------------
    def column(self, schema: T.StructType) -> Column:
        return self._joined([term.column(schema) for term in self.terms] + [child.column(schema) for child in self.children])

    def on(self, item: Column, dtype: T.DataType) -> Column:
        """The query on one value, such as an item of an array, whose fields the terms name."""
        terms = [term.test(*paths.path_below(item, dtype, term.field.split("."))) for term in self.terms]
        return self._joined(terms + [child.on(item, dtype) for child in self.children])

    def _joined(self, parts: list[Column]) -> Column:
        if not parts:
            return F.lit(True)
        return reduce((lambda a, b: a & b) if self.joiner == "all" else (lambda a, b: a | b), parts)

    def filter(self, df: DataFrame) -> DataFrame:
        return df if not (self.terms or self.children) else df.filter(self.column(df.schema))

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.filter(df)
        if self.order:
            out = out.orderBy(*sort_columns(df.schema, self.order))
        if self.row_offset:
            out = out.offset(self.row_offset)
        if self.row_limit is not None:
            out = out.limit(self.row_limit)
        if self.fields:
            out = include_fields(out, self.fields) if self.include else exclude_fields(out, self.fields)
        return out


def all_of(*queries: Query) -> Query:
    return Query("all", children=tuple(queries))


def any_of(*queries: Query) -> Query:
    return Query("any", children=tuple(queries))


def sort_columns(schema: T.StructType, order: Sequence[Order]) -> list[Column]:
    """Missing values come first ascending and last descending."""
    columns = [(paths.value_at(schema, name), sign) for name, sign in order]
    return [column.asc_nulls_first() if sign >= 0 else column.desc_nulls_last() for column, sign in columns]


def by_example(template: Mapping[str, Any], prefix: str = "") -> Query:
    """Every non-null member of the template becomes an equality; nested templates become dotted paths."""
    query = all_of()
    for name, value in template.items():
        if isinstance(value, Mapping):
            query = replace(query, terms=query.terms + by_example(value, f"{prefix}{name}.").terms)
        elif value is not None:
            query = query.when(prefix + name, value)
    return query


def from_document(document: Mapping[str, Any], limit: int | None = None) -> Query:
    """Query of a JSON document. ``and`` wins over ``or``, and either wins over leaf members beside it."""
    for member, start in (("and", all_of), ("or", any_of)):
        if document.get(member):
            query = start(*[from_document(child) for child in document[member]])
            return query if limit is None else query.limit(limit)
    query = all_of()
    for name, value in (document.get("when") or {}).items():
        query = query.when(name, value)
    for name, value in (document.get("whenNot") or {}).items():
        query = query.when_not(name, value)
    for name, values in (document.get("withAny") or {}).items():
        query = query.with_any(name, values)
    for name, values in (document.get("withAll") or {}).items():
        query = query.with_all(name, values)
    for name in document.get("withPresent") or ():
        query = query.with_present(name)
    for name in document.get("withNotPresent") or ():
        query = query.with_not_present(name)
    for name, (value, exclusive) in (document.get("rangeAbove") or {}).items():
        query = query.range_above(name, value, exclusive)
    for name, (value, exclusive) in (document.get("rangeBelow") or {}).items():
        query = query.range_below(name, value, exclusive)
    for name, ((low, low_exclusive), (high, high_exclusive)) in (document.get("rangeIn") or {}).items():
        query = query.range_in(name, low, low_exclusive, high, high_exclusive)
    return query if limit is None else query.limit(limit)


# projections ------------------------------------------------------------------------------------------------------


def include_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep dotted fields; a nested field keeps its place in its parent."""
    tops: dict[str, list[str]] = {}
    for name in names:
        head, _, rest = name.partition(".")
        tops.setdefault(head, []).append(rest)
    columns = []
    for head, rests in tops.items():
        if head not in df.columns:
            continue
        if "" in rests or not isinstance(df.schema[head].dataType, T.StructType):
            columns.append(F.col(f"`{head}`"))
        else:
            columns.append(_prune(F.col(f"`{head}`"), df.schema[head].dataType, rests).alias(head))
    return df.select(*columns)


def _prune(column: Column, dtype: T.StructType, names: Sequence[str]) -> Column:
    tops: dict[str, list[str]] = {}
    for name in names:
        head, _, rest = name.partition(".")
        tops.setdefault(head, []).append(rest)
    members = []
    for head, rests in tops.items():
        if head not in dtype.fieldNames():
            continue
        inner = dtype[head].dataType
        member = column.getField(head)
        if "" not in rests and isinstance(inner, T.StructType):
            member = _prune(member, inner, rests)
        members.append(member.alias(head))
    return F.when(column.isNotNull(), F.struct(*members))


def exclude_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop dotted fields; an empty list keeps everything."""
    flat = [name for name in names if "." not in name]
    nested: dict[str, list[str]] = {}
    for name in names:
        head, _, rest = name.partition(".")
        if rest and head in df.columns and head not in flat:
            nested.setdefault(head, []).append(rest)
    out = df.drop(*flat)
    return out.withColumns({head: F.col(f"`{head}`").dropFields(*rests) for head, rests in nested.items()}) if nested else out


def with_mutations(df: DataFrame, mutations: Mapping[str, Column]) -> DataFrame:
    """The original row plus overriding or new members."""
    return df.withColumns(dict(mutations))


@dataclass(frozen=True)
class FieldMatcher:
    """Column choice by name, by simple glob and by type class (``number``, ``string``, ``date``); excludes win."""

    names: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    exclude_names: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()

    def columns(self, schema: T.StructType) -> list[str]:
        import re

        from docsieve.functions.globs import simple_glob_regex

        def hit(item: T.StructField, names, globs, types) -> bool:
            return (
                item.name in names
                or any(re.match(simple_glob_regex(glob), item.name, re.I) for glob in globs)
                or type_class(item.dataType) in types
            )

        everything = not (self.names or self.globs or self.types)
        return [
            item.name
            for item in schema.fields
            if (everything or hit(item, self.names, self.globs, self.types))
            and not hit(item, self.exclude_names, self.exclude_globs, self.exclude_types)
        ]


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "other"


def select_columns(df: DataFrame, matcher: FieldMatcher) -> DataFrame:
    return df.select(*[F.col(f"`{name}`") for name in matcher.columns(df.schema)])


def override_types(df: DataFrame, rules: Mapping[str, FieldMatcher]) -> DataFrame:
    """Cast the columns each matcher picks; values that do not fit become null."""
    casts = {name: F.col(f"`{name}`").try_cast(dtype) for dtype, matcher in rules.items() for name in matcher.columns(df.schema)}
    return df.withColumns(casts) if casts else df


# predicates used on their own -------------------------------------------------------------------------------------


def scoped(df: DataFrame, extra: Query | Column) -> DataFrame:
    """A view of ``df`` every read, count, update and delete goes through: the extra predicate always holds."""
    return df.filter(extra.column(df.schema) if isinstance(extra, Query) else extra)


def outside_threshold(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """True below ``low`` or above ``high``; a missing value counts as 0."""
    filled = F.coalesce(value.cast("double"), F.lit(0.0))
    terms = ([filled < F.lit(float(low))] if low is not None else []) + ([filled > F.lit(float(high))] if high is not None else [])
    return reduce(lambda a, b: a | b, terms, F.lit(False)) if terms else F.lit(False)


# fixed values: severities from least to most severe
SEVERITIES = ("ALL", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF")


def meets_level(severity: Column, subsystem: Column, default: str, overrides: Mapping[str, str] | None = None) -> Column:
    """Severity is at least the subsystem's own threshold, else the default threshold."""

    def rank(level: Column) -> Column:
        return F.array_position(F.array(*[F.lit(name) for name in SEVERITIES]), F.upper(level))

    threshold = F.lit(SEVERITIES.index(default.upper()) + 1).cast("bigint")
    for name, level in (overrides or {}).items():
        threshold = F.when(subsystem == name, F.lit(SEVERITIES.index(level.upper()) + 1).cast("bigint")).otherwise(threshold)
    return rank(severity) >= threshold


def semi_any(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """``with_any`` for a value list that is itself a table: a left semi join on its first column."""
    key = values.columns[0]
    return df.join(values.select(F.col(key).alias("__value")), paths.value_at(df.schema, name) == F.col("__value"), "left_semi")


def first_by_id(df: DataFrame, id_column: str, value: Any) -> DataFrame:
    return df.filter(F.col(id_column) == _literal(value)).limit(1)


def count_by(df: DataFrame, query: Query | None = None) -> DataFrame:
    """One row with the number of matches."""
    return (query.filter(df) if query else df).agg(F.count(F.lit(1)).alias("n"))


def exists_by(df: DataFrame, query: Query) -> DataFrame:
    """One row telling whether anything matches; at most one row per partition is looked at."""
    return query.filter(df).select(F.lit(1).alias("hit")).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))
