"""Streams into batches: by time (the trigger), by count and by size; emission to folders and message streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from docsieve.operators.ordered import Running, running
from docsieve.sources.writers import to_messages


def cut_by_count(df: DataFrame, order: Sequence[str], rows: int, chunks: int | None = None) -> DataFrame:
    """Add ``__batch``: consecutive batches of exactly ``rows`` rows in arrival order (the last may be shorter)."""
    numbered = running(df, [], order, {"__number": Running("count")}, chunks)
    batch = F.floor((F.col("__number") - 1) / rows).cast("bigint")
    return numbered.withColumn("__batch", batch).drop("__number")


def cut_by_size(df: DataFrame, order: Sequence[str], kilobytes: float, chunks: int | None = None) -> DataFrame:
    """Add ``__batch``: consecutive batches of about ``kilobytes`` of JSON; a row belongs where its first byte falls."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]))).cast("double")
    sized = df.withColumn("__size", size)
    summed = running(sized, [], order, {"__bytes": Running("sum", F.col("__size"))}, chunks)
    batch = F.floor((F.col("__bytes") - F.col("__size")) / F.lit(kilobytes * 1024.0)).cast("bigint")
    return summed.withColumn("__batch", batch).drop("__size", "__bytes")


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Start a stream that hands each micro-batch to ``handle``: every ``every``, or everything there is and then stop.

    Each named consumer has its own ``checkpoint`` and so sees the whole stream; two runs with the same checkpoint share it.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def emit_to_folder(stream: DataFrame, folder: str, checkpoint: str, fmt: str = "parquet", every: str | None = None) -> StreamingQuery:
    """Stream rows to a folder, exactly once."""
    writer = stream.writeStream.format(fmt).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def emit_to_messages(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Stream rows as JSON messages (a folder of text; with the Kafka connector the same frame goes to a topic)."""
    return emit_to_folder(to_messages(stream), folder, checkpoint, "text", every)


def emit_to_bucket_and_messages(bucket_folder: str, message_folder: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Micro-batch handler writing to the bucket and to its listeners; a repeated batch overwrites its own folders."""

    def handle(df: DataFrame, batch_id: int) -> None:
        folder = f"{bucket_folder}/batch={batch_id}"
        df.write.mode("overwrite").format(fmt).save(folder)
        kept = df.sparkSession.read.format(fmt).schema(df.schema).load(folder)  # what was written, not computed again
        to_messages(kept).write.mode("overwrite").text(f"{message_folder}/batch={batch_id}")

    return handle
