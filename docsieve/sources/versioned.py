"""Atomic replacement of a folder's content on plain files.

New data goes to a new version folder; a small pointer file then names it. Readers resolve the pointer first, so they see the
whole old or the whole new data. The two newest versions are kept, older ones may be removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from docsieve.sources import layout

_POINTER = "_current"
_VERSIONS = "versions"
_MARKS = "_batches"


def current_folder(spark: SparkSession, folder: str) -> str:
    """Folder a reader has to load: the version pointed to, or the folder itself if it has no versions."""
    name = layout.read_small(spark, f"{folder}/{_POINTER}")
    return f"{folder}/{_VERSIONS}/{name.strip()}" if name else folder


def has_version(spark: SparkSession, folder: str) -> bool:
    return layout.read_small(spark, f"{folder}/{_POINTER}") is not None


def batch_marks(spark: SparkSession, folder: str) -> dict[str, int]:
    """Last batch of each streaming query that the current version contains."""
    text = layout.read_small(spark, f"{current_folder(spark, folder)}/{_MARKS}") if has_version(spark, folder) else None
    return json.loads(text) if text else {}


def replace_folder(
    df: DataFrame,
    folder: str,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    options: dict[str, str] | None = None,
    marks: dict[str, int] | None = None,
) -> str:
    """Write ``df`` as the new content of ``folder`` and switch to it. ``df`` may read the old content.

    Batch marks of the old version go on, with ``marks`` added: the pointer switches rows and marks together.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    noted = batch_marks(spark, folder) | (marks or {})
    writer = df.write.format(fmt).options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{folder}/{_VERSIONS}/{version}")
    if noted:
        layout.write_small(spark, f"{folder}/{_VERSIONS}/{version}/{_MARKS}", json.dumps(noted))
    layout.write_small(spark, f"{folder}/{_POINTER}", version)
    return version


def remove_old_versions(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove all but the newest versions (the current one always stays); returns the folders removed."""
    current = current_folder(spark, folder)
    fs, location = layout.hadoop_path(spark, f"{folder}/{_VERSIONS}")
    if not fs.exists(location):
        return []
    found = sorted(((item.getModificationTime(), item.getPath().toString()) for item in fs.listStatus(location)), reverse=True)
    stale = [path for _, path in found[keep:] if not path.endswith(current.rsplit("/", 1)[-1])]
    for path in stale:
        layout.remove(spark, path)
    return stale


def purge(spark: SparkSession, folder: str, fmt: str = "parquet") -> None:
    """Delete all rows, keeping the schema."""
    empty = spark.read.format(fmt).load(current_folder(spark, folder)).limit(0)
    replace_folder(empty, folder, fmt)
