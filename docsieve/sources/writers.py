"""Sinks: batched, sliced, compressed and replacing writes; tables."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from docsieve.functions import timefn
from docsieve.operators import routing, timeslice
from docsieve.operators.buckets import coerce
from docsieve.operators.update import upsert
from docsieve.sources import layout
from docsieve.sources.layout import Bucket, exists
from docsieve.sources.versioned import current_folder, replace_folder

# fixed values: codec names and what Spark calls them (framed snappy has no Spark writer; plain snappy stands in)
CODECS = {"": "none", "plain": "none", "gz": "gzip", "gzip": "gzip", "sz": "snappy", "snappy": "snappy", "fr.sz": "snappy", "snappy_framed": "snappy"}

SIZE_ROWS = 10_000  # rows whose JSON is measured for batches by size


@dataclass(frozen=True)
class WriteSettings:
    """Size of written files in rows and in kilobytes of JSON, the number of writing tasks, and how often a stream is flushed."""

    batch_max_objects: int | None = None
    target_write_concurrency: int | None = None
    codec: str = "snappy"
    batch_max_size_kb: float | None = None
    batch_flush_interval: str | None = None

    def writer(self, df: DataFrame, fmt: str):
        out = df if self.target_write_concurrency is None else df.repartition(self.target_write_concurrency)
        writer = out.write.format(fmt).option("compression", CODECS[self.codec])
        rows = [n for n in (self.batch_max_objects, self._rows_of_size(df)) if n is not None]
        return writer.option("maxRecordsPerFile", min(rows)) if rows else writer

    def _rows_of_size(self, df: DataFrame) -> int | None:
        """Rows that make up the largest batch at the mean size of ``SIZE_ROWS`` rows, the first Spark comes by: an estimate, not a pass."""
        if self.batch_max_size_kb is None:
            return None
        mean = df.limit(SIZE_ROWS).agg(F.avg(F.octet_length(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns])))).alias("b")).first()["b"]
        return max(1, int(self.batch_max_size_kb * 1024 / mean)) if mean else None

    def flush(self) -> dict[str, str]:
        """Arguments for the functions that start streams: how often batches are written."""
        return {"every": self.batch_flush_interval} if self.batch_flush_interval else {}


def write_sliced(
    df: DataFrame,
    bucket: Bucket,
    stage: str = "processed",
    policy: str = "batch",
    settings: WriteSettings = WriteSettings(),
    batch: Sequence[str] = (),
    order: Sequence[str] = (),
    files_per_slice: int | None = None,
) -> None:
    """Append to a stage, partitioned by time slice.

    Rows are spread over ``files_per_slice`` tasks per slice by a salt taken from the row, so that a heavy slice is not written by
    one task and a task does not open a file in every slice.
    """
    period = bucket.slice_period or "month"
    ts = bucket.time_field
    if ts:
        rows = timeslice.with_slice(df, ts, period, policy, batch, order)
    else:
        rows = df.withColumn(timeslice.SLICE, F.lit("all_time"))
    if files_per_slice:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in df.columns]), F.lit(files_per_slice))
        rows = rows.repartition(F.col(timeslice.SLICE), salt)
    folder = current_folder(df.sparkSession, bucket.stage(stage))
    settings.writer(rows, bucket.format).mode("append").partitionBy(timeslice.SLICE).save(folder)


def write_stage(df: DataFrame, bucket: Bucket, stage: str, preserve_existing: bool = True, job: str | None = None, settings: WriteSettings = WriteSettings()) -> None:
    """Append to a stage, or replace it atomically."""
    folder = bucket.stage(stage, job)
    fmt = "json" if stage == "json" else "text" if stage == "raw" else bucket.format
    if preserve_existing:
        settings.writer(df, fmt).mode("append").save(current_folder(df.sparkSession, folder))
    else:
        replace_folder(df, folder, fmt, options={"compression": CODECS[settings.codec]})


def write_upsert(df: DataFrame, bucket: Bucket, stage: str = "processed", delete_ids: DataFrame | None = None) -> None:
    """Replace stored rows by id, insert the others, drop deleted ids: one new version of the stage."""
    spark = df.sparkSession
    folder = bucket.stage(stage)
    if not exists(spark, folder):
        replace_folder(df, folder, bucket.format)
        return
    stored = spark.read.format(bucket.format).load(current_folder(spark, folder))
    if delete_ids is not None:
        stored = stored.join(delete_ids.select(bucket.id_column), bucket.id_column, "left_anti")
    replace_folder(upsert(stored, df, bucket.id_column), folder, bucket.format)


def write_results(df: DataFrame, bucket: Bucket, dedup_configured: bool, delete_ids: DataFrame | None = None) -> str:
    """Bucket write mode: keyed replacement exactly when deduplication is configured, else append."""
    if dedup_configured:
        write_upsert(df, bucket, delete_ids=delete_ids)
        return "upsert"
    write_stage(df, bucket, "processed")
    return "append"


def age_out_stage(spark: SparkSession, bucket: Bucket, stage: str, max_age: str, now: dt.datetime, grace: str | None = None) -> list[str]:
    """Remove the slices of a stage that ended before the age limit; returns the removed folders. Each stage has its own limit.

    With ``grace`` (``1 hour``) no reader loses files under its feet: a run first notes expired slices in a small file, by which scans of the
    stage leave them out from then on, and removes only those noted at least that long before ``now``; readers that listed them earlier
    have this time to finish. Without it folders go at once, and a reader that listed them before may find files gone.
    """
    root = current_folder(spark, bucket.stage(stage))
    marked = [
        (folder, folder.rsplit(f"{timeslice.SLICE}=", 1)[1].replace("%3A", ":")) for folder in layout.list_folders(spark, root) if f"{timeslice.SLICE}=" in folder
    ]
    if not marked:
        return []
    listing = spark.createDataFrame(marked, "folder string, path string")
    expired = {row["path"]: row["folder"] for row in timeslice.expired_slices(listing, max_age, now).collect()}
    noted = layout.aged_out(spark, root)
    if grace is not None:
        due = timefn.span_of(grace).shift(now, -1).isoformat()
        kept = {name: noted.get(name, now.isoformat()) for name in expired if noted.get(name, now.isoformat()) > due}
        layout.write_small(spark, f"{root}/{layout.AGED_OUT}", json.dumps({**noted, **kept}))
        expired = {name: folder for name, folder in expired.items() if name not in kept}
    for folder in expired.values():
        layout.remove(spark, folder)
    # a slice is named until its folder is gone, so that a run that dies in between hides it still
    left = {name: since for name, since in layout.aged_out(spark, root).items() if name not in expired}
    if grace is not None or noted:
        layout.write_small(spark, f"{root}/{layout.AGED_OUT}", json.dumps(left))
    return list(expired.values())


def write_partitioned_targets(external: DataFrame, root: str, fmt: str = "parquet") -> None:
    """All targets in one job: one folder per target, any number of targets."""
    external.write.format(fmt).mode("append").partitionBy(routing.TARGET).save(root)


def to_messages(df: DataFrame) -> DataFrame:
    """Rows as the JSON strings a topic or a folder of text carries."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns])).alias("value"))


def write_table(
    df: DataFrame,
    name: str,
    table_format: T.StructType | None = None,
    mode: str = "append",
    bucket_by: tuple[int, Sequence[str]] | None = None,
    folder: str | None = None,
) -> None:
    """A warehouse table, optionally of a declared format, bucketed for joins on its key, and at a given folder."""
    rows = coerce(df, table_format) if table_format is not None else df
    writer = rows.write.mode(mode).format("parquet")
    if folder:
        writer = writer.option("path", folder)
    if bucket_by:
        count, keys = bucket_by
        writer = writer.bucketBy(count, *keys).sortBy(*keys)
    writer.saveAsTable(name)


def table_format_of(declared: Mapping[str, str]) -> T.StructType:
    """``StructType`` of a declared format: SQL type names, ``[t]`` arrays, ``[string t]`` maps, ``{k:t,...}`` structs, ``[{} t ...]`` unions.

    Spark has no union type: a union becomes a struct with one nullable member per choice.
    """
    return T.StructType([T.StructField(name, _declared_type(text)) for name, text in declared.items()])


def _declared_type(text: str) -> T.DataType:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        parts = _split(text[1:-1], " ")
        if parts[0] == "{}":
            return T.StructType([T.StructField(f"member{index}", _declared_type(part)) for index, part in enumerate(parts[1:])])
        if len(parts) == 1:
            return T.ArrayType(_declared_type(parts[0]))
        return T.MapType(_declared_type(parts[0]), _declared_type(parts[1]))
    if text.startswith("{") and text.endswith("}"):
        members = [part.split(":", 1) for part in _split(text[1:-1], ",")]
        return T.StructType([T.StructField(name.strip(), _declared_type(kind)) for name, kind in members])
    return T.DataType.fromDDL(text.upper())


def _split(text: str, separator: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in text:
        depth += (char in "[{(") - (char in "]})")
        if char == separator and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [part for part in [*parts, current] if part.strip()]


def log_writer(root: str, fmt: str = "parquet") -> Callable[[DataFrame], None]:
    """Writer for log rows: one folder per bucket, weekly slices."""

    def write(df: DataFrame) -> None:
        rows = timeslice.with_slice(df, "date", "week", "record")
        rows.write.format(fmt).mode("append").partitionBy("bucket", timeslice.SLICE).save(root)

    return write
