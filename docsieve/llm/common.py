"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Byte table: A-Z lower-cased, every other byte as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Byte table: A-Z lower-cased, every ASCII byte that is no letter or digit a space. Bytes from 0x80 on belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and a lost executor costs no recomputation."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: CRC-32 of the id as text, modulo 5, is 0. A null id has no CRC and is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def worker_cache(key: object, build: Callable[[], object], keep: int = 2) -> object:
    """One object per key and Python worker, kept while Spark reuses the worker (vocabularies, automata); the last ``keep`` stay."""
    holder = sys.modules.setdefault("docsieve_worker_cache", types.ModuleType("docsieve_worker_cache"))
    store = holder.__dict__.setdefault("store", {})
    found = store.pop(key, None)
    store[key] = build() if found is None else found
    while len(store) > keep:
        del store[next(iter(store))]
    return store[key]


def slices(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches in parts of a few rows, so that Python objects exist of a few texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
