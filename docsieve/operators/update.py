"""Mutations as rewrites: updates, deletes and upserts give the resulting DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docsieve.operators.query import Query, from_document


def _values(value: Any) -> list[Any]:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _array_of(values: list[Any], dtype: T.ArrayType) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast(dtype)


@dataclass(frozen=True)
class Change:
    kind: str
    field: str
    value: Any = None

    def column(self, old: Column, dtype: T.DataType) -> Column:
        """New value of the field from its old value."""
        if self.kind == "set":
            value = self.value if isinstance(self.value, Column) else F.lit(self.value)
            return value.cast(dtype)
        if self.kind == "unset":
            return F.lit(None).cast(dtype)
        if self.kind == "increment":
            return (F.coalesce(old, F.lit(0)) + F.lit(self.value)).cast(dtype)
        if not isinstance(dtype, T.ArrayType):
            raise TypeError(f"{self.kind} needs an array field: {self.field}")
        empty = F.array().cast(dtype)
        if self.kind == "add":
            return F.concat(F.coalesce(old, empty), _array_of(_values(self.value), dtype))
        if self.kind == "add_unique":
            kept = F.coalesce(old, empty)
            return F.concat(kept, F.array_except(_array_of(_values(self.value), dtype), kept))
        if isinstance(self.value, Query):
            # each array item is a record the query is matched against
            return F.filter(old, lambda item: ~F.coalesce(self.value.on(item, dtype.elementType), F.lit(False)))
        unwanted = _array_of(_values(self.value), dtype)
        return F.filter(old, lambda item: ~F.coalesce(F.array_contains(unwanted, item), F.lit(False)))


@dataclass(frozen=True)
class Update:
    """A list of changes, applied together to the rows a predicate selects."""

    changes: tuple[Change, ...] = ()

    def _with(self, change: Change) -> "Update":
        return replace(self, changes=self.changes + (change,))

    def set(self, name: str, value: Any) -> "Update":
        return self._with(Change("set", name, value))

    def unset(self, name: str) -> "Update":
        return self._with(Change("unset", name))

    def increment(self, name: str, by: int | float) -> "Update":
        return self._with(Change("increment", name, by))

    def add(self, name: str, value: Any, dedup: bool = False) -> "Update":
        return self._with(Change("add_unique" if dedup else "add", name, value))

    def remove(self, name: str, value: Any) -> "Update":
        return self._with(Change("remove", name, value))

    def nested(self, name: str, update: "Update") -> "Update":
        return replace(self, changes=self.changes + tuple(replace(each, field=f"{name}.{each.field}") for each in update.changes))

    def apply(self, df: DataFrame, where: Column | None = None) -> DataFrame:
        """Every row, the selected ones changed. A row for which the predicate is null is not selected."""
        out: dict[str, Column] = {}
        for change in self.changes:
            head, _, rest = change.field.partition(".")
            if head not in df.columns:
                raise KeyError(f"no such column: {head}")
            dtype = df.schema[head].dataType
            base = out.get(head, F.col(f"`{head}`"))
            out[head] = _rewrite(base, dtype, rest, change)
        if where is not None:
            hit = F.coalesce(where, F.lit(False))
            out = {name: F.when(hit, column).otherwise(F.col(f"`{name}`")) for name, column in out.items()}
        return df.withColumns(out) if out else df


def _rewrite(column: Column, dtype: T.DataType, rest: str, change: Change) -> Column:
    if not rest:
        return change.column(column, dtype)
    head, _, deeper = rest.partition(".")
    if isinstance(dtype, T.MapType):
        if deeper:
            raise KeyError(f"no path below a map value: {change.field}")
        kept = F.map_filter(column, lambda key, _: key != F.lit(head))
        if change.kind == "unset":
            return kept
        value = change.column(F.try_element_at(column, F.lit(head)), dtype.valueType)
        return F.map_concat(F.coalesce(kept, F.create_map().cast(dtype)), F.create_map(F.lit(head), value))
    inner = dtype[head].dataType
    return column.withField(head, _rewrite(column.getField(head), inner, deeper, change))


def from_template(template: Mapping[str, Any], prefix: str = "") -> Update:
    """Every non-null member of a template becomes a ``set``."""
    update = Update()
    for name, value in template.items():
        if isinstance(value, Mapping):
            update = replace(update, changes=update.changes + from_template(value, f"{prefix}{name}.").changes)
        elif value is not None:
            update = update.set(prefix + name, value)
    return update


def from_update_document(document: Mapping[str, Any]) -> tuple[Query, Update]:
    """Query and update of ``{query, add, increment, remove, set, unset}``; ``add`` maps a field to (value, dedup)."""
    update = Update()
    for name, (value, dedup) in (document.get("add") or {}).items():
        update = update.add(name, value, dedup)
    for name, by in (document.get("increment") or {}).items():
        update = update.increment(name, by)
    for name, value in (document.get("remove") or {}).items():
        update = update.remove(name, value)
    for name, value in (document.get("set") or {}).items():
        update = update.set(name, value)
    for name in document.get("unset") or ():
        update = update.unset(name)
    return from_document(document.get("query") or {}), update


def update_many(df: DataFrame, query: Query, update: Update) -> DataFrame:
    return update.apply(df, query.column(df.schema))


def update_one(df: DataFrame, query: Query, update: Update, id_column: str) -> DataFrame:
    """Change the match with the smallest id. Ids are unique, so one bounded aggregate decides which."""
    smallest = query.filter(df).agg(F.min(id_column).alias("id")).scalar()
    return update.apply(df, F.col(id_column) == smallest)


def updated_count(df: DataFrame, query: Query) -> DataFrame:
    return df.agg(F.count_if(query.column(df.schema)).cast("bigint").alias("n"))


def update_and_return(df: DataFrame, query: Query, update: Update, before: bool = False) -> DataFrame:
    """Image of the changed rows before or after the change."""
    matched = query.filter(df)
    return matched if before else update.apply(matched)


def delete_many(df: DataFrame, query: Query) -> DataFrame:
    return df.filter(~F.coalesce(query.column(df.schema), F.lit(False)))


def delete_one(df: DataFrame, query: Query, id_column: str) -> DataFrame:
    smallest = query.filter(df).agg(F.min(id_column).alias("id")).scalar()
    return df.filter(~F.coalesce(F.col(id_column) == smallest, F.lit(False)))


def upsert(stored: DataFrame, changes: DataFrame, id_column: str = "_id") -> DataFrame:
    """Stored rows whose id is not among the changes, plus the changes (ids are unique on both sides)."""
    kept = stored.join(changes.select(id_column), id_column, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def insert_new(stored: DataFrame, rows: DataFrame, id_column: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Insert without replacing: (resulting rows, refused rows whose id is already stored). A missing id is assigned."""
    keyed = rows.withColumn(id_column, F.coalesce(F.col(id_column), F.uuid()))
    ids = stored.select(id_column)
    fresh = keyed.join(ids, id_column, "left_anti")
    refused = keyed.join(ids, id_column, "left_semi")
    return stored.unionByName(fresh, allowMissingColumns=True), refused

