"""Exact batches by count or size on a live stream: cuts do not depend on how rows arrive in micro-batches.

Rows are written once, with the number of the batch they belong to, one part folder per micro-batch. A small state file holds the
running total, which alone says which batches are full; rows behind the last full one are the remainder and stay where they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from docsieve.operators.ordered import Running, running
from docsieve.sources import layout
from docsieve.streaming.stored import query_of

BATCH = "__batch"
_END = "__end"
_STATE = "_state"
# nothing read yet: no parts, total 0, and the open batch (number 0) would start in part 0
_FRESH = {"part": -1, "total": 0, "since": 0, "query": None, "batch": -1}


def _state(spark: SparkSession, folder: str) -> dict:
    text = layout.read_small(spark, f"{folder}/{_STATE}")
    return json.loads(text) if text else dict(_FRESH)


def _parts(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    return spark.read.parquet(*[f"{folder}/part={number}" for number in range(first, last + 1)])


def cut_into(
    folder: str,
    order: Sequence[str],
    rows: int | None = None,
    kilobytes: float | None = None,
    handle: Callable[[DataFrame, int], None] | None = None,
    chunks: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler that cuts a stream into batches of exactly ``rows`` rows, or of about ``kilobytes`` of JSON.

    Arrival order is the micro-batch, then ``order``, which has to be unique within a micro-batch. A row belongs to the batch its
    first byte (or its number) falls into. ``handle`` gets the rows of the batches that a micro-batch filled, with ``__batch``, and the number of
    the part. The state is written last: a micro-batch run again after a failure writes and hands out the same cuts under the same
    part number, one run again after its end changes nothing. A stream with a new checkpoint goes on behind the rows already cut.
    Micro-batches may be empty; rows may hold nulls anywhere. One stream at a time may write to a folder.
    """
    if (rows is None) == (kilobytes is None):
        raise ValueError("either rows or kilobytes")
    limit = float(rows if rows is not None else kilobytes * 1024.0)
    if limit <= 0:
        raise ValueError("a batch holds something")

    def cut(df: DataFrame, batch_id: int) -> None:
        spark, query = df.sparkSession, query_of(df)
        state = _state(spark, folder)
        if state["query"] == query and batch_id <= state["batch"]:
            return
        part, before = state["part"] + 1, state["total"]
        size = F.lit(1) if rows is not None else F.octet_length(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns])))
        sized = df.withColumn("__size", size.cast("double"))
        summed = running(sized, [], order, {_END: Running("sum", F.col("__size"))}, chunks)
        ends = summed.withColumn(_END, F.col(_END) + F.lit(float(before)))
        numbered = ends.withColumn(BATCH, F.floor((F.col(_END) - F.col("__size")) / F.lit(limit)).cast("bigint"))
        numbered.drop("__size").write.mode("overwrite").parquet(f"{folder}/part={part}")

        reached = _parts(spark, folder, part, part).agg(F.max(_END).alias("end")).first()["end"]
        total = before if reached is None else int(reached)
        was_open, is_open = int(before // limit), int(total // limit)
        if handle is not None and is_open > was_open:
            full = _parts(spark, folder, state["since"], part).filter((F.col(BATCH) >= was_open) & (F.col(BATCH) < is_open))
            handle(full.drop(_END), part)
        since = part if is_open > was_open else state["since"]
        noted = {"part": part, "total": total, "since": since, "query": query, "batch": batch_id}
        layout.write_small(spark, f"{folder}/{_STATE}", json.dumps(noted))

    return cut


def full_batches(spark: SparkSession, folder: str, rows: int | None = None, kilobytes: float | None = None, with_open: bool = False) -> DataFrame:
    """Rows cut so far with ``__batch``: the full batches, or all rows with the remainder as the last batch."""
    if (rows is None) == (kilobytes is None):
        raise ValueError("either rows or kilobytes")
    state = _state(spark, folder)
    if state["part"] < 0:
        raise FileNotFoundError(folder)
    found = spark.read.option("basePath", folder).parquet(folder).filter(F.col("part") <= state["part"]).drop(_END, "part")
    limit = float(rows if rows is not None else kilobytes * 1024.0)
    return found if with_open else found.filter(F.col(BATCH) < int(state["total"] // limit))
