"""Folder layout of buckets and the small file-system calls it needs (through Hadoop, so any store Spark can reach)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

# fixed values: copies a bucket keeps
STAGES = ("raw", "json", "processed", "transient_output", "transient_input")

AGED_OUT = "_aged_out.json"  # names the slices of a stage that scans leave out


@dataclass(frozen=True)
class Bucket:
    """A dataset with a path-like name; ``root`` is the folder all buckets lie under."""

    full_name: str
    root: str
    format: str = "parquet"
    time_field: str | None = None
    slice_period: str | None = None
    id_column: str = "_id"
    tags: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def folder(self) -> str:
        return self.root.rstrip("/") + self.full_name

    def stage(self, name: str = "processed", job: str | None = None) -> str:
        if name not in STAGES:
            raise ValueError(f"unknown stage: {name}")
        tail = f"/{job}" if job else ""
        return f"{self.folder}/stored/{name}{tail}"

    def topic(self, stage: str = "$end") -> str:
        """Folder of the messages a stage of the bucket's processing emits; ``$start`` and ``$end`` are its ends."""
        return f"{self.folder}/topics/{stage.lstrip('$')}"

    @property
    def ready(self) -> str:
        """Folder new files are dropped in."""
        return f"{self.folder}/import/ready"


def state_bucket(owner: Bucket, job: str, name: str) -> Bucket:
    """Small keyed collection a job keeps between runs."""
    return Bucket(f"{owner.full_name}/_state/{job}/{name}", owner.root, owner.format, id_column=owner.id_column)


def parse_address(address: str, own: Bucket) -> tuple[Bucket, str]:
    """(bucket, stage) of an input address: ``/b`` is the end of bucket b, ``/b:`` its start, ``/b:x`` its stage x, ``x`` a stage of the
    bucket itself. Other buckets lie under the same root."""
    if not address.startswith("/"):
        return own, address
    name, colon, stage = address.partition(":")
    return Bucket(name, own.root, own.format), (stage or "$start") if colon else "$end"


def hadoop_path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of a location."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    fs, location = hadoop_path(spark, path)
    return bool(fs.exists(location))


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Direct sub-folders of a folder (a listing of directories, not of files)."""
    fs, location = hadoop_path(spark, path)
    if not fs.exists(location):
        return []
    return sorted(item.getPath().toString() for item in fs.listStatus(location) if item.isDirectory())


def read_small(spark: SparkSession, path: str) -> str | None:
    """Text of a small control file, or None."""
    fs, location = hadoop_path(spark, path)
    if not fs.exists(location):
        return None
    stream = fs.open(location)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def aged_out(spark: SparkSession, folder: str) -> dict[str, str]:
    """Slices of a stage's folder that scans leave out, with the time they were noted."""
    return json.loads(read_small(spark, f"{folder}/{AGED_OUT}") or "{}")


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small control file in one rename, so that a reader sees the old or the new text."""
    fs, location = hadoop_path(spark, path)
    _, staged = hadoop_path(spark, path + ".next")
    stream = fs.create(staged, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(location.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(location), rename)


def remove(spark: SparkSession, path: str) -> None:
    fs, location = hadoop_path(spark, path)
    fs.delete(location, True)

