"""Dot paths into nested columns, JSON strings and Variants.

Two readings of a path exist and both are kept:

* ``value_at`` (property lookup): an array met on the way stands for its first element;
* ``query_path`` (predicates): an array met on the way stands for all its elements, so a predicate matches when any does.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from docsieve.functions.timefn import let

_SCALARS = (
    T.StringType,
    T.LongType,
    T.IntegerType,
    T.ShortType,
    T.ByteType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
    T.BooleanType,
    T.TimestampType,
    T.TimestampNTZType,
    T.DateType,
)


def _field(schema: T.StructType, name: str) -> T.StructField | None:
    return schema[name] if name in schema.fieldNames() else None


def _descend(column: Column, dtype: T.DataType, name: str) -> tuple[Column, T.DataType] | None:
    """One step down by name; None when the step cannot exist."""
    if isinstance(dtype, T.StructType):
        field = _field(dtype, name)
        return None if field is None else (column.getField(name), field.dataType)
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        return F.try_element_at(column, F.lit(name)), dtype.valueType
    return None


def locate(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type at ``path`` under the property-lookup reading, or None if the schema has no such path."""
    head, *rest = path.split(".")
    field = _field(schema, head)
    if field is None:
        return None
    column, dtype = F.col(f"`{head}`"), field.dataType
    for name in rest:
        while isinstance(dtype, T.ArrayType):
            column, dtype = F.get(column, F.lit(0)), dtype.elementType
        step = _descend(column, dtype, name)
        if step is None:
            return None
        column, dtype = step
    return column, dtype


def value_at(schema: T.StructType, path: str) -> Column:
    """Property lookup; a path the schema does not have is a null column."""
    found = locate(schema, path)
    return F.lit(None) if found is None else found[0]


def key_value_at(schema: T.StructType, path: str) -> Column:
    """Value usable as a grouping key: scalars only, anything else is null."""
    found = locate(schema, path)
    if found is None or not isinstance(found[1], _SCALARS):
        return F.lit(None).cast("string")
    return found[0]


def _members(array: Column, name: str) -> Column:
    return F.transform(array, lambda item: item.getField(name))


def query_path(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """Column and type at ``path`` under the any-element reading; arrays of records give arrays of their field."""
    head, *rest = path.split(".")
    field = _field(schema, head)
    if field is None:
        return F.lit(None), T.NullType()
    return path_below(F.col(f"`{head}`"), field.dataType, rest)


def path_below(column: Column, dtype: T.DataType, names: list[str]) -> tuple[Column, T.DataType]:
    """``query_path`` from a column of known type."""
    for name in names:
        if isinstance(dtype, T.ArrayType):
            element = dtype.elementType
            if not isinstance(element, T.StructType) or _field(element, name) is None:
                return F.lit(None), T.NullType()
            inner = element[name].dataType
            column = _members(column, name)
            if isinstance(inner, T.ArrayType):
                column, dtype = F.flatten(column), inner
            else:
                dtype = T.ArrayType(inner)
            continue
        step = _descend(column, dtype, name)
        if step is None:
            return F.lit(None), T.NullType()
        column, dtype = step
    return column, dtype


def json_value_at(variant: Column, path: str, dtype: str = "string") -> Column:
    """Property lookup inside a Variant column (``try_parse_json`` of a JSON string); JSON null counts as missing.

    One step a level: an array met on the way stands for its first element.
    """
    *above, last = path.split(".")
    for name in above:
        inner = F.try_variant_get(variant, f"$.{name}", "variant")
        variant = let(inner, lambda v: F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v))
    return F.try_variant_get(variant, f"$.{last}", dtype)


def json_typed(text: Column, dtype: str) -> Column:
    """A JSON text as a typed value (string, bigint, double, boolean, array<...>, struct<...>), null if it does not fit."""
    return F.try_variant_get(F.try_parse_json(text), "$", dtype)


def fold_into_json(text: Column, overrides: dict[str, tuple[Column, str]]) -> Column:
    """Overlay columns on the object held by a JSON string; a same-named member is replaced, others stay. The result is JSON text.

    ``overrides`` maps member name to (column, Spark type). Numbers, texts, booleans, objects and nulls stay what they are. A null text
    is an empty object; a text that is no object gives null (see ``not_an_object``).
    """
    empty = F.create_map().cast("map<string,variant>")
    base = F.when(text.isNull(), empty).otherwise(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"))
    kept = F.map_filter(base, lambda key, _: ~key.isin(list(overrides)))
    new = [part for name, (column, dtype) in overrides.items() for part in (F.lit(name), column.cast(dtype).cast("variant"))]
    return F.to_json(F.map_concat(kept, F.create_map(*new)) if new else kept)


def not_an_object(text: Column) -> Column:
    """Rows ``fold_into_json`` refuses, for the error channel."""
    return text.isNotNull() & F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>").isNull()
