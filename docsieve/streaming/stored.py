"""Deduplicating a stream into a stored bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from docsieve.operators.dedup import DedupConfig, dedup
from docsieve.operators.update import upsert
from docsieve.sources import bucketed, layout, versioned

_QUERY_ID = "sql.streaming.queryId"


def query_of(df: DataFrame) -> str:
    """Id of the streaming query a micro-batch belongs to; Spark keeps it in the checkpoint. Outside a stream: the empty text."""
    return df.sparkSession.sparkContext.getLocalProperty(_QUERY_ID) or ""


def dedup_into(folder: str, config: DedupConfig, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: deduplicate against the folder's current version and switch to a new one.

    Each version notes, per streaming query, the last batch it contains. A batch is skipped only if the current version holds it
    from that very query, whose numbers rise: a batch run again after a failure changes nothing, and other streams, fresh checkpoints
    and stores written by other means lose nothing. Plain files have no row-level merge: every batch rewrites the stage. For a large store use
    ``dedup_into_buckets``, or ``dedup_into_table`` where a table format merges rows.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        spark, query = df.sparkSession, query_of(df)
        done = versioned.batch_marks(spark, folder)
        if query in done and batch_id <= done[query]:
            return
        if not versioned.has_version(spark, folder) and not layout.exists(spark, folder):
            stored = df.limit(0)
        else:
            stored = spark.read.format(fmt).load(versioned.current_folder(spark, folder))
        result = dedup(df, stored, config, small_batch=True)
        kept = stored.join(result.delete.select(config.id_column), config.id_column, "left_anti")
        versioned.replace_folder(upsert(kept, result.emit, config.id_column), folder, fmt, marks={query: batch_id})

    return handle


def dedup_into_buckets(folder: str, config: DedupConfig, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """The same into a store of hash buckets (``sources/bucketed.py``), made if missing: only buckets with a changed id are written.

    Rows and the mark of the batch switch together, so a batch run again changes nothing. Stored rows of a key may lie in any bucket: their
    keys are read, their rows are not.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        spark, query = df.sparkSession, query_of(df)
        store = bucketed.manifest(spark, folder) or bucketed.create(spark, folder, config.id_column, buckets)
        if query in store.marks and batch_id <= store.marks[query]:
            return
        stored = bucketed.read(spark, folder) if store.schema is not None else df.limit(0)
        result = dedup(df, stored, config, small_batch=True)
        bucketed.change(spark, folder, result.emit, result.delete, marks={query: batch_id})

    return handle


def dedup_into_table(table: str, config: DedupConfig, marks: str) -> Callable[[DataFrame, int], None]:
    """The same into a table whose format supports row-level merge: only changed and deleted rows are written.

    ``marks`` is a folder for the last batch of each query. It is noted behind the merge, so a batch may be merged twice; merging by id
    the second time writes the same rows.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        spark, query = df.sparkSession, query_of(df)
        mark = f"{marks}/{query or 'batch'}"
        if layout.read_small(spark, mark) == str(batch_id):
            return
        result = dedup(df, spark.table(table), config, small_batch=True)
        source = merge_source(result.emit, result.delete, config.id_column)
        key = config.id_column
        (
            source.mergeInto(table, F.expr(f"{table}.`{key}` = s.`{key}`"))
            .whenMatched(F.expr("s.__delete")).delete()
            .whenMatched().update({name: F.expr(f"s.`{name}`") for name in result.emit.columns})
            .whenNotMatched(F.expr("not s.__delete")).insert({name: F.expr(f"s.`{name}`") for name in result.emit.columns})
            .merge()
        )
        layout.write_small(spark, mark, str(batch_id))

    return handle


def merge_source(emit: DataFrame, delete: DataFrame, id_column: str) -> DataFrame:
    """Rows of one merge, named ``s``: those to write, and ids to delete that are not written again, marked ``__delete``."""
    gone = delete.select(id_column).distinct().join(emit.select(id_column), id_column, "left_anti")
    rows = emit.withColumn("__delete", F.lit(False)).unionByName(gone.withColumn("__delete", F.lit(True)), allowMissingColumns=True)
    return rows.alias("s")
