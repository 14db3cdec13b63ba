"""Scans of buckets, batch and streaming."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from docsieve.operators import timeslice
from docsieve.operators.buckets import BUCKET, matching_buckets
from docsieve.operators.grouped import tag_inputs
from docsieve.operators.query import Query
from docsieve.sources.layout import Bucket, aged_out, list_folders, parse_address
from docsieve.sources.versioned import current_folder


@dataclass(frozen=True)
class Input:
    """One job input: a bucket stage with an optional time range, filter and limit."""

    name: str
    bucket: Bucket
    stage: str = "processed"
    job: str | None = None
    time_min: str | None = None
    time_max: str | None = None
    exact_times: bool = False
    filter: Query | None = None
    record_limit: int | None = None
    schema: T.StructType | None = None
    enabled: bool = True
    service: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | None, options: Mapping[str, str]):
    reader = spark.read.format(fmt).options(**options)
    return reader.schema(schema) if schema is not None else reader


def scan_stage(spark: SparkSession, bucket: Bucket, stage: str = "processed", job: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """All data of a bucket's stage but for slices noted as aged out. The slice column appears when the stage is partitioned by it."""
    fmt = "json" if stage == "json" else "text" if stage == "raw" else bucket.format
    folder = current_folder(spark, bucket.stage(stage, job))
    df = _reader(spark, fmt, schema, {}).load(folder)
    if timeslice.SLICE in df.columns and not isinstance(df.schema[timeslice.SLICE].dataType, T.StringType):
        # folder names such as 2024.10 look like numbers; as numbers they would neither compare nor print right
        named = [T.StructField(f.name, T.StringType() if f.name == timeslice.SLICE else f.dataType) for f in df.schema.fields]
        df = _reader(spark, fmt, T.StructType(named), {}).load(folder)
    hidden = sorted(aged_out(spark, folder)) if timeslice.SLICE in df.columns else []
    return df.filter(~F.coalesce(F.col(timeslice.SLICE), F.lit("")).isin(hidden)) if hidden else df


def scan_bucket_set(
    spark: SparkSession, buckets: Sequence[Bucket], patterns: Sequence[str], stage: str = "processed", schema: T.StructType | None = None
) -> DataFrame:
    """All buckets the patterns match, with ``__bucket`` and, where a bucket is sliced, ``__slice``, by which Spark prunes folders.

    One branch per bucket, so formats and roots may differ and each bucket's name is its own, not read off a path. Columns a bucket does
    not have are null. With a ``schema`` no file is opened to find one.
    """
    wanted = set(matching_buckets([bucket.full_name for bucket in buckets], patterns))
    chosen = [bucket for bucket in buckets if bucket.full_name in wanted]
    if not chosen:
        raise LookupError(f"no bucket matches {list(patterns)}")
    out = None
    for bucket in chosen:
        part = scan_stage(spark, bucket, stage, schema=schema).withColumn(BUCKET, F.lit(bucket.full_name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def scan_ready(spark: SparkSession, bucket: Bucket, fmt: str = "json", schema: T.StructType | None = None) -> DataFrame:
    """Files dropped for import."""
    return _reader(spark, fmt, schema, {"recursiveFileLookup": "true"}).load(bucket.ready)


def scan_dated_folders(
    spark: SparkSession, folder: str, low: dt.datetime | None, high: dt.datetime | None, fmt: str = "json", schema: T.StructType | None = None
) -> DataFrame:
    """Scan of dated folders written by other tools (``name_2015.06.01``): only folders overlapping the range are read.

    The folder names are metadata; their number does not grow with the rows in them. A bad range raises, it never widens the scan.
    """
    names = list_folders(spark, folder)
    if not names:
        raise FileNotFoundError(folder)
    listing = spark.createDataFrame([(name,) for name in names], "path string")
    keep = [row["path"] for row in timeslice.prune_directories(listing, low, high).collect()]
    if not keep:
        return spark.createDataFrame([], schema) if schema is not None else _reader(spark, fmt, schema, {}).load(names[0]).limit(0)
    return _reader(spark, fmt, schema, {"recursiveFileLookup": "true"}).load(keep)


def scan_binary(spark: SparkSession, folder: str, glob: str | None = None, with_content: bool = True) -> DataFrame:
    """File records: path, time, length and, unless left out, content (not read when it is not selected). Spark skips empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    return files if with_content else files.select("path", "length", "modificationTime")


def count_files(spark: SparkSession, folder: str) -> DataFrame:
    return scan_binary(spark, folder, with_content=False).agg(F.count(F.lit(1)).alias("n"))


def scan_service(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    """Any source Spark has a reader for."""
    path = options.pop("path", None)
    reader = spark.read.format(fmt).options(**options)
    return reader.load(path) if path else reader.load()


def scan_input(spark: SparkSession, item: Input, now: dt.datetime) -> DataFrame:
    """An input as a DataFrame: stage, time range, filter, limit."""
    if item.service:
        df = scan_service(spark, item.service, **dict(item.options))
    else:
        df = scan_stage(spark, item.bucket, item.stage, item.job, item.schema)
    low, high = timeslice.time_range(item.time_min, item.time_max, now)
    if low is not None or high is not None:
        bucket = item.bucket
        if timeslice.SLICE in df.columns and bucket.slice_period:
            df = timeslice.sliced_scan(df, bucket.time_field or "", bucket.slice_period, low, high, exact=item.exact_times)
        elif bucket.time_field:
            bound = lambda moment: F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
            if low is not None:
                df = df.filter(F.col(bucket.time_field) >= bound(low))
            if high is not None:
                df = df.filter(F.col(bucket.time_field) <= bound(high))
        else:
            raise ValueError(f"{bucket.full_name} has neither slices nor a time field")
    if item.filter is not None:
        df = item.filter.filter(df)
    return df if item.record_limit is None else df.limit(item.record_limit)


def scan_inputs(spark: SparkSession, inputs: Sequence[Input], now: dt.datetime) -> DataFrame:
    """All enabled inputs of a job as one DataFrame with ``__input``."""
    return tag_inputs({item.name: scan_input(spark, item, now) for item in inputs if item.enabled})


def stream_folder(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None, **options: str
) -> DataFrame:
    """A folder as a stream: each run sees the files not served yet (with ``trigger(availableNow=True)`` and a checkpoint)."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(folder)


def stream_topic(spark: SparkSession, servers: str, topic: str, schema: T.StructType, **options: str) -> DataFrame:
    """A topic of JSON strings (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def stream_address(spark: SparkSession, address: str, own: Bucket, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """The messages an input address names, as a stream of rows."""
    bucket, stage = parse_address(address, own)
    messages = stream_folder(spark, bucket.topic(stage), T.StructType([T.StructField("value", T.StringType())]), "text", max_files)
    return messages.select(F.from_json("value", schema).alias("r")).select("r.*")


def warehouse_view(df: DataFrame, table: str, sql: str, view: str) -> DataFrame:
    """A view given by SQL over a bucket's table."""
    df.createOrReplaceTempView(table)
    out = df.sparkSession.sql(sql)
    out.createOrReplaceTempView(view)
    return out

