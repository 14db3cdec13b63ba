"""Services as Spark sources: a client says how its rows split and fetches a split; Spark plans, filters, retries and streams.

A client is a plain class that workers can unpickle. It takes the reader's options and offers ``schema``, ``splits``, ``fetch`` and, for
streams, ``latest`` and ``splits_between``. Filters Spark can push reach ``fetch`` as Arrow expressions; the client applies them where
the data is, and Spark applies them once more only where the client cannot.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Client(Protocol):
    """What a service has to offer. ``fetch`` may run in any worker, any number of times, and gives the same rows each time."""

    def schema(self) -> T.StructType: ...

    def splits(self) -> Sequence[Any]: ...

    def fetch(self, split: Any, columns: list[str], condition: pc.Expression | None) -> Iterator[pa.RecordBatch]: ...


class StreamClient(Client, Protocol):
    """A service whose rows keep coming. An offset is a small JSON mapping; rows up to an offset never change."""

    def start(self) -> dict: ...

    def latest(self) -> dict: ...

    def splits_between(self, start: dict, end: dict) -> Sequence[Any]: ...


@dataclass
class _Split(ds.InputPartition):
    value: Any


def _plain(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.DateType, T.DecimalType))


def condition(pushed: ds.Filter, schema: T.StructType) -> pc.Expression | None:
    """A pushed filter as an Arrow expression of the same meaning, nulls included; None where there is none.

    Floating numbers stay with Spark, which orders NaN, and so do nested columns, times (zones) and filters on texts by order.
    """
    if isinstance(pushed, ds.Not):
        # in both languages the negation of unknown is unknown, which keeps no row
        inner = condition(pushed.child, schema)
        return None if inner is None else ~inner
    path = getattr(pushed, "attribute", ())
    if len(path) != 1 or path[0] not in schema.names:
        return None
    field, kind = pc.field(path[0]), schema[path[0]].dataType
    if isinstance(pushed, ds.IsNull):
        return field.is_null()
    if isinstance(pushed, ds.IsNotNull):
        return field.is_valid()
    if not _plain(kind):
        return None
    arrow = to_arrow_schema(T.StructType([schema[path[0]]])).field(0).type
    if isinstance(pushed, ds.EqualTo):
        return None if pushed.value is None else field == pa.scalar(pushed.value, arrow)
    if isinstance(pushed, ds.In):
        known = [value for value in pushed.value if value is not None]
        if len(known) < len(pushed.value):
            return None
        return reduce(operator.or_, [field == pa.scalar(value, arrow) for value in known]) if known else None
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return pc.starts_with(field, pushed.value) if isinstance(pushed, ds.StringStartsWith) else None
    compare = {
        ds.GreaterThan: operator.gt,
        ds.GreaterThanOrEqual: operator.ge,
        ds.LessThan: operator.lt,
        ds.LessThanOrEqual: operator.le,
    }.get(type(pushed))
    return None if compare is None or pushed.value is None else compare(field, pa.scalar(pushed.value, arrow))


class _Reader(ds.DataSourceReader):
    def __init__(self, client: Client, schema: T.StructType):
        self.client, self.schema, self.terms = client, schema, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for pushed in filters:
            term = condition(pushed, self.schema)
            if term is None:
                yield pushed
            else:
                self.terms.append(term)

    def partitions(self) -> list[_Split]:
        return [_Split(value) for value in self.client.splits()]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a service without splits has no rows
            return
        wanted = reduce(operator.and_, self.terms) if self.terms else None
        yield from self.client.fetch(partition.value, self.schema.names, wanted)


class _StreamReader(ds.DataSourceStreamReader):
    def __init__(self, client: StreamClient, schema: T.StructType):
        self.client, self.schema = client, schema

    def initialOffset(self) -> dict:
        return self.client.start()

    def latestOffset(self) -> dict:
        return self.client.latest()

    def partitions(self, start: dict, end: dict) -> list[_Split]:
        return [_Split(value) for value in self.client.splits_between(start, end)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        yield from self.client.fetch(partition.value, self.schema.names, None)


def service_source(name: str, client: type) -> type[ds.DataSource]:
    """A data source called ``name`` over ``client(options)``; to be given to ``spark.dataSource.register``."""

    class ServiceSource(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return client(dict(self.options)).schema()

        def reader(self, schema: T.StructType) -> ds.DataSourceReader:
            return _Reader(client(dict(self.options)), schema)

        def streamReader(self, schema: T.StructType) -> ds.DataSourceStreamReader:
            return _StreamReader(client(dict(self.options)), schema)

    return ServiceSource


def register(spark: SparkSession, name: str, client: type) -> None:
    """Make a client readable as ``spark.read.format(name)`` and ``readStream``, with filters pushed to it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(service_source(name, client))


def scan(spark: SparkSession, name: str, columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Rows of a registered service. With ``columns`` only these are fetched: Spark tells Python sources no projection."""
    reader = spark.read.format(name).options(**options)
    if columns is None:
        return reader.load()
    whole = reader.load().schema
    return reader.schema(T.StructType([whole[column] for column in columns])).load()


class ParquetParts:
    """Client of a folder (or file) of Parquet, whose unit is the row group: a split is a file and some of its row groups.

    Options: ``path`` and ``rowsPerSplit`` (1 000 000). As a stream, its offset is the number of files in the order of their names, so
    new files have to sort behind the old ones. Files without rows give no split.
    """

    def __init__(self, options: dict[str, str]):
        lower = {key.lower(): value for key, value in options.items()}
        self.path, self.rows = lower["path"], int(lower.get("rowspersplit", 1_000_000))

    def _files(self) -> list[str]:
        system, root = self._open()
        if system.get_file_info(root).type == pafs.FileType.File:
            return [root]
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        return sorted(item.path for item in found if item.is_file and item.base_name.endswith(".parquet"))

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path.removeprefix("file:"))

    def schema(self) -> T.StructType:
        system, _ = self._open()
        return from_arrow_schema(pads.dataset(self._files()[:1], filesystem=system, format="parquet").schema)

    def _splits(self, files: list[str]) -> list[tuple[str, list[int]]]:
        system, _ = self._open()
        out = []
        for path in files:
            groups, rows = [], 0
            fragment = next(iter(pads.dataset([path], filesystem=system, format="parquet").get_fragments()))
            for group in fragment.row_groups:
                if groups and rows + group.num_rows > self.rows:
                    out.append((path, groups))
                    groups, rows = [], 0
                groups, rows = [*groups, group.id], rows + group.num_rows
            if rows:
                out.append((path, groups))
        return out

    def splits(self) -> list[tuple[str, list[int]]]:
        return self._splits(self._files())

    def fetch(self, split: tuple[str, list[int]], columns: list[str], condition: pc.Expression | None) -> Iterator[pa.RecordBatch]:
        system, _ = self._open()
        path, groups = split
        fragment = next(iter(pads.dataset([path], filesystem=system, format="parquet").get_fragments()))
        # row groups whose statistics rule the condition out are not opened
        yield from fragment.subset(row_group_ids=groups).to_batches(columns=columns, filter=condition, batch_size=8192)

    def start(self) -> dict:
        return {"files": 0}

    def latest(self) -> dict:
        return {"files": len(self._files())}

    def splits_between(self, start: dict, end: dict) -> list[tuple[str, list[int]]]:
        return self._splits(self._files()[start["files"] : end["files"]])
