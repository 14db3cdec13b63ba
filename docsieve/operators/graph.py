"""Vertices and edges out of records: decomposition, merging by key, resolution of edge ends."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docsieve.functions import globs
from docsieve.operators.grouped import GroupReducer, reduce_groups

# fixed values: default key of a vertex
DEDUP_FIELDS = ("name", "type")


@dataclass(frozen=True)
class VertexRule:
    """A vertex per record: its key members and label, as columns of the record."""

    type: str
    name: Column
    properties: Mapping[str, Column] = field(default_factory=dict)
    label: Column | None = None


@dataclass(frozen=True)
class EdgeRule:
    """An edge per record between the vertices of two vertex rules (by position)."""

    label: str
    source: int
    target: int
    properties: Mapping[str, Column] = field(default_factory=dict)


def _properties(values: Mapping[str, Column]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    parts = [part for name, column in values.items() for part in (F.lit(name), column.cast("string"))]
    return F.map_filter(F.create_map(*parts), lambda _, value: value.isNotNull())


def _key(rule: VertexRule) -> Column:
    return F.struct(rule.name.cast("string").alias("name"), F.lit(rule.type).alias("type"))


def vertices(df: DataFrame, rules: Sequence[VertexRule], path: Column, time: Column) -> DataFrame:
    """Vertices of every record: ``name, type, label, properties, path, time``; records naming no vertex give none."""
    items = [
        F.struct(
            rule.name.cast("string").alias("name"),
            F.lit(rule.type).alias("type"),
            (rule.label if rule.label is not None else rule.name).cast("string").alias("label"),
            _properties(rule.properties).alias("properties"),
        )
        for rule in rules
    ]
    rows = df.select(F.explode(F.array(*items)).alias("v"), path.alias("path"), time.alias("time"))
    return rows.select("v.*", "path", "time").filter(F.col("name").isNotNull())


def edges(df: DataFrame, vertex_rules: Sequence[VertexRule], rules: Sequence[EdgeRule], path: Column, time: Column) -> DataFrame:
    """Edges of every record, ends given by vertex key: ``label, out_key, in_key, properties, path, time``."""
    items = [
        F.struct(
            F.lit(rule.label).alias("label"),
            _key(vertex_rules[rule.source]).alias("out_key"),
            _key(vertex_rules[rule.target]).alias("in_key"),
            _properties(rule.properties).alias("properties"),
        )
        for rule in rules
    ]
    rows = df.select(F.explode(F.array(*items)).alias("e"), path.alias("path"), time.alias("time"))
    return rows.select("e.*", "path", "time").filter(F.col("out_key.name").isNotNull() & F.col("in_key.name").isNotNull())


def decompose(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """User decomposition: ``fn`` gets pandas frames and yields element rows. The records themselves are passed on unchanged."""
    return df.mapInPandas(fn, schema)


def merge_elements(elements: DataFrame, keys: Sequence[str] = DEDUP_FIELDS, id_column: str = "id") -> DataFrame:
    """One element per key: first and last time, the distinct paths, newest properties, and an id derived from the key.

    Paths are the buckets an element came from, so their set is small. The source is read once: each element gives one row per member
    and one marker row without a member for its own values. Rows combine map-side per key and member, so what meets per key is one row
    per member name, however many elements there are.
    """
    names = list(keys)
    marker = F.array(F.struct(F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("value")))
    own = F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("member"), e["value"].alias("value")))
    rows = elements.select(*names, "time", "path", F.inline(F.concat(marker, F.coalesce(own, F.slice(marker, 1, 0)))))
    base = F.col("member").isNull()
    parts = rows.groupBy(*names, "member").agg(
        F.min("time").alias("created"),
        F.max("time").alias("modified"),
        F.collect_set(F.when(base, F.col("path"))).alias("paths"),
        F.count(F.lit(1)).alias("seen"),
        F.max(F.struct("time", "value")).getField("value").alias("value"),
    )
    pairs = F.array_sort(F.collect_list(F.when(~base, F.struct("member", "value"))))
    merged = parts.groupBy(*names).agg(
        F.max(F.when(base, F.col("created"))).alias("created"),
        F.max(F.when(base, F.col("modified"))).alias("modified"),
        F.array_sort(F.flatten(F.collect_list(F.when(base, F.col("paths"))))).alias("paths"),
        F.max(F.when(base, F.col("seen"))).alias("seen"),
        F.when(F.count("member") > 0, F.map_from_entries(pairs)).alias("properties"),
    )
    return merged.withColumn(id_column, F.md5(F.to_json(F.struct(*names))))


def merge_into_stored(
    merged: DataFrame,
    stored: DataFrame,
    contexts: Sequence[str] = (),
    keys: Sequence[str] = DEDUP_FIELDS,
    id_column: str = "id",
    bucket_column: str = "__bucket",
) -> DataFrame:
    """Merged elements with what is stored about them in the context buckets: a stored id and the wider time span win."""
    names = list(keys)
    scope = stored.filter(globs.matches_path(F.col(bucket_column), list(contexts))) if contexts else stored
    known = scope.groupBy(*names).agg(
        F.min(F.struct(bucket_column, id_column)).getField(id_column).alias("__id"),
        F.min("created").alias("__created"),
        F.max("modified").alias("__modified"),
    )
    return merged.join(known, names, "left").withColumns(
        {
            id_column: F.coalesce("__id", id_column),
            "created": F.least("created", "__created"),
            "modified": F.greatest("modified", "__modified"),
        }
    ).drop("__id", "__created", "__modified")


def merge_custom(
    elements: DataFrame,
    reducer: type[GroupReducer],
    reduced_schema: T.StructType | str,
    schema: T.StructType | str,
    keys: Sequence[str] = DEDUP_FIELDS,
    finalize_all: bool = True,
) -> DataFrame:
    """User merge per element key. Without ``finalize_all`` only keys with more than one element reach the function."""
    rows = elements
    if not finalize_all:
        repeated = elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select(*keys)
        rows = elements.join(repeated, list(keys), "left_semi")
    return reduce_groups(rows, keys, reducer, reduced_schema, schema)


def resolve_edges(edge_rows: DataFrame, merged_vertices: DataFrame, id_column: str = "id") -> DataFrame:
    """Edges with ``out_id`` and ``in_id``; identical edges are counted together first, so hub vertices meet few rows."""
    distinct = edge_rows.groupBy("label", "out_key", "in_key").agg(
        F.count(F.lit(1)).alias("seen"), F.min("time").alias("created"), F.max("time").alias("modified")
    )
    ids = merged_vertices.select(F.struct("name", "type").alias("__key"), F.col(id_column).alias("__id"))
    out = distinct.join(ids.withColumnRenamed("__id", "out_id"), F.col("out_key") == F.col("__key")).drop("__key")
    return out.join(ids.withColumnRenamed("__id", "in_id"), F.col("in_key") == F.col("__key")).drop("__key")
