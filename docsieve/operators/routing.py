"""Routing rows to targets, allow-listed emission to other buckets, and the error channel."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docsieve.functions import globs, paths
from docsieve.session import written

TARGET = "__target"
REASON = "__reason"

# fixed values: routing words
INTERNAL = "$$internal"
STOP = "$$stop"


def route(df: DataFrame, output: str | None) -> DataFrame:
    """Rows with ``__target``: null for the bucket itself, else the path of another bucket.

    ``output`` is ``$$internal`` (or empty), ``$$stop``, ``$field`` (the row names its target, which must not start with ``$``)
    or a bucket path.
    """
    if not output or output == INTERNAL:
        return df.withColumn(TARGET, F.lit(None).cast("string"))
    if output == STOP:
        return df.withColumn(TARGET, F.lit(None).cast("string")).filter(F.lit(False))
    if output.startswith("$"):
        found = paths.locate(df.schema, output[1:])
        named = found[0] if found is not None and isinstance(found[1], T.StringType) else F.lit(None).cast("string")
        rows = df.withColumn(TARGET, named).filter(F.col(TARGET).isNotNull() & ~F.col(TARGET).startswith("$"))
        # a row may also name no target at all, which means the bucket itself
        return rows.withColumn(TARGET, F.when(F.col(TARGET) != "", F.col(TARGET)))
    return df.withColumn(TARGET, F.lit(output))


@dataclass(frozen=True)
class Emission:
    """``internal``: rows for the bucket itself; ``external``: rows with an allowed ``__target``; ``errors``: the rest."""

    internal: DataFrame
    external: DataFrame
    errors: DataFrame


def emit_allowed(
    routed: DataFrame,
    allowed: Sequence[str],
    sub_buckets: Sequence[str] = (),
    writable: Column | None = None,
    test_mode: bool = False,
) -> Emission:
    """Split routed rows by target. A target needs to match an allow-list glob (own sub-buckets need none) and be writable.

    In test mode everything is checked but nothing is handed on for writing.
    """
    target = F.col(TARGET)
    sub = target.isin(list(sub_buckets)) if sub_buckets else F.lit(False)
    listed = globs.matches_path(target, list(allowed))
    permitted = writable if writable is not None else F.lit(True)
    reason = F.when(~(sub | listed), F.lit("target not in the allow-list")).when(~sub & ~permitted, F.lit("target not writable"))
    outward = routed.filter(target.isNotNull()).withColumn(REASON, reason)
    good = outward.filter(F.col(REASON).isNull()).drop(REASON)
    return Emission(
        routed.filter(target.isNull()).drop(TARGET),
        good.filter(F.lit(False)) if test_mode else good,
        outward.filter(F.col(REASON).isNotNull()),
    )


def fan_out(df: DataFrame, writers: dict[str, Callable[[DataFrame], None]]) -> list[str]:
    """Write one DataFrame to several targets, computing it once; targets sharing a writer are written once.

    With several writers the rows go to the shared folder first, so a lost executor costs no second computation.
    """
    distinct: dict[int, tuple[str, Callable[[DataFrame], None]]] = {}
    for name, writer in writers.items():
        distinct.setdefault(id(writer), (name, writer))
    source = written(df, "fan-out") if len(distinct) > 1 else df
    for _, writer in distinct.values():
        writer(source)
    return [name for name, _ in distinct.values()]


def error_channel(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows passing every check, and rows failing any with ``__reason`` naming the first failed check."""
    reason = None
    for name, check in checks.items():
        failed = ~F.coalesce(check, F.lit(False))
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    tagged = df.withColumn(REASON, reason if reason is not None else F.lit(None).cast("string"))
    return tagged.filter(F.col(REASON).isNull()).drop(REASON), tagged.filter(F.col(REASON).isNotNull())


def log_rows(
    df: DataFrame,
    date: Column,
    message: Column,
    generated_by: str,
    bucket: Column,
    subsystem: Column,
    command: Column,
    severity: Column,
    hostname: str,
    details: Sequence[str] = (),
) -> DataFrame:
    """Log rows: the details flattened beside the standard members."""
    return df.select(
        *[F.col(f"`{name}`") for name in details],
        date.alias("date"),
        message.alias("message"),
        F.lit(generated_by).alias("generated_by"),
        bucket.alias("bucket"),
        subsystem.alias("subsystem"),
        command.alias("command"),
        severity.alias("severity"),
        F.lit(hostname).alias("hostname"),
    )
