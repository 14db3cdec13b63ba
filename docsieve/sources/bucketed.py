"""Stored rows in hash buckets of their id: a change writes the buckets it touches, all others keep their files.

A manifest names one folder per bucket and is replaced in one rename, so readers see all of a change or nothing of it. Folders a newer
manifest no longer names stay until ``remove_unnamed``, so readers that started before a change are not disturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from docsieve.operators.update import upsert
from docsieve.session import written
from docsieve.sources import layout

_MANIFEST = "_manifest"
_NUMBER = "__bucket_number"


@dataclass(frozen=True)
class Manifest:
    """What a store holds: id column, number of buckets, folder of each bucket that has rows, schema, last batch of each stream."""

    id_column: str
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    schema: T.StructType | None = None
    marks: dict[str, int] = field(default_factory=dict)


def manifest(spark: SparkSession, folder: str) -> Manifest | None:
    text = layout.read_small(spark, f"{folder}/{_MANIFEST}")
    if text is None:
        return None
    kept = json.loads(text)
    schema = T.StructType.fromJson(kept["schema"]) if kept["schema"] else None
    return Manifest(kept["id_column"], kept["buckets"], {int(n): path for n, path in kept["folders"].items()}, schema, kept["marks"])


def _switch(spark: SparkSession, folder: str, new: Manifest) -> Manifest:
    schema = new.schema.jsonValue() if new.schema is not None else None
    kept = {"id_column": new.id_column, "buckets": new.buckets, "folders": new.folders, "schema": schema, "marks": new.marks}
    layout.write_small(spark, f"{folder}/{_MANIFEST}", json.dumps(kept))
    return new


def create(spark: SparkSession, folder: str, id_column: str, buckets: int) -> Manifest:
    """A store without rows. ``buckets`` is for good: take it so that a bucket is a few files of the wanted size."""
    if buckets < 1:
        raise ValueError("a store has at least one bucket")
    if layout.exists(spark, f"{folder}/{_MANIFEST}"):
        raise FileExistsError(folder)
    return _switch(spark, folder, Manifest(id_column, buckets))


def _opened(spark: SparkSession, folder: str) -> Manifest:
    found = manifest(spark, folder)
    if found is None:
        raise FileNotFoundError(folder)
    return found


def _number(store: Manifest) -> Column:
    # as text, so that an id has one bucket whatever its numeric type
    return F.pmod(F.xxhash64(F.col(f"`{store.id_column}`").cast("string")), F.lit(store.buckets)).cast("int")


def _load(spark: SparkSession, folder: str, store: Manifest, numbers: Iterable[int] | None = None) -> DataFrame | None:
    if store.schema is None:
        return None
    paths = [f"{folder}/{store.folders[n]}" for n in (sorted(store.folders) if numbers is None else numbers) if n in store.folders]
    return spark.read.schema(store.schema).parquet(*paths) if paths else spark.createDataFrame([], store.schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows. A store that never had any has no schema and raises."""
    rows = _load(spark, folder, _opened(spark, folder))
    if rows is None:
        raise LookupError(f"{folder} holds nothing yet")
    return rows


def read_ids(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """Rows with one of the ids; only the buckets these fall into are opened."""
    store = _opened(spark, folder)
    rows = _load(spark, folder, store, _touched(ids, store))
    if rows is None:
        raise LookupError(f"{folder} holds nothing yet")
    return rows.join(ids.select(store.id_column).distinct(), store.id_column, "left_semi")


def _touched(ids: DataFrame, store: Manifest) -> list[int]:
    """Numbers of the buckets that the ids fall into: at most the number of buckets."""
    return sorted(row["n"] for row in ids.select(_number(store).alias("n")).distinct().collect())


def _merged(old: T.StructType | None, new: T.StructType) -> T.StructType:
    if old is None:
        return T.StructType([T.StructField(f.name, f.dataType) for f in new.fields])
    known = {f.name: f.dataType for f in old.fields}
    for f in new.fields:
        if known.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"{f.name} is {known[f.name].simpleString()} in the store, not {f.dataType.simpleString()}")
    return T.StructType([*old.fields, *[T.StructField(f.name, f.dataType) for f in new.fields if f.name not in known]])


def change(
    spark: SparkSession, folder: str, rows: DataFrame | None = None, delete: DataFrame | None = None, marks: dict[str, int] | None = None
) -> list[int]:
    """Write ``rows`` (each replaces the stored row of its id) and remove the ids in ``delete``; returns the buckets written.

    An id in both is written. Ids in ``rows`` are unique; rows with a null id replace nothing. New columns are added to the store and are null in
    older rows; a column of another type is refused. ``rows`` and ``delete`` may be computed from the store itself: they are written aside first.
    Without any change nothing but ``marks`` is noted.
    """
    store = _opened(spark, folder)
    key = store.id_column
    noted = store.marks | (marks or {})
    rows = written(rows, "changes") if rows is not None else None
    gone = written(delete.select(key).distinct(), "deletions") if delete is not None else None
    touched = set(_touched(rows, store)) if rows is not None else set()
    if gone is not None:
        touched |= {number for number in _touched(gone, store) if number in store.folders}
    schema = _merged(store.schema, rows.schema) if rows is not None else store.schema
    if not touched:
        _switch(spark, folder, replace(store, schema=schema, marks=noted))
        return []
    content = _load(spark, folder, replace(store, schema=schema), sorted(touched))
    if gone is not None:
        content = content.join(gone, key, "left_anti")
    if rows is not None:
        content = upsert(content, rows, key)
    written_as = f"rows-{uuid.uuid4().hex}"
    # rebalanced, so that a large bucket is split among tasks and small ones share one
    numbered = content.select(*schema.names).withColumn(_NUMBER, _number(store)).hint("rebalance", F.col(_NUMBER))
    numbered.write.partitionBy(_NUMBER).parquet(f"{folder}/{written_as}")
    filled = {int(path.rsplit("=", 1)[-1]) for path in layout.list_folders(spark, f"{folder}/{written_as}")}
    folders = {n: path for n, path in store.folders.items() if n not in touched}
    folders |= {n: f"{written_as}/{_NUMBER}={n}" for n in filled}
    _switch(spark, folder, replace(store, folders=folders, schema=schema, marks=noted))
    return sorted(touched)


def remove_unnamed(spark: SparkSession, folder: str, keep: Iterable[Manifest] = ()) -> list[str]:
    """Remove bucket folders that neither the manifest nor one of ``keep`` (manifests still being read) names; returns them.

    Not to be run beside a change.
    """
    named = {path for store in (_opened(spark, folder), *keep) for path in store.folders.values()}
    stale = []
    for group in layout.list_folders(spark, folder):
        for path in layout.list_folders(spark, group):
            if "/".join(path.rsplit("/", 2)[-2:]) not in named:
                stale.append(path)
                layout.remove(spark, path)
    return stale
