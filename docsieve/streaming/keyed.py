"""Running merges and emission rules on a stream in which no key is tied to one task.

A micro-batch is cut into chunks like a table (``operators/ordered.py``) and joined with the state its keys had before: a few numbers a
key, in a store of hash buckets. ``streaming/stateful.py`` is for formatters, whose chain needs one task a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docsieve.operators.merge import Rules, throttle
from docsieve.operators.ordered import Running, null_safe_join, running
from docsieve.session import written
from docsieve.sources import bucketed
from docsieve.streaming.stored import query_of

_KEY = "__state_key"
_STATE = ("count", "total", "last", "mark", "seen")
_MERGED = ("merge_count", "merge_sum", "pair_min", "pair_max")


def _by_rule(rules: Rules, value: Column) -> Column:
    """True where a rule without memory lets a merged row through."""
    filled = F.coalesce(value, F.lit(0.0))
    terms = [F.lit(rules.none)]
    if rules.every_nth is not None:
        terms.append(F.col("merge_count") % rules.every_nth == 0)
    if rules.below is not None:
        terms.append(filled < rules.below)
    if rules.above is not None:
        terms.append(filled > rules.above)
    return reduce(lambda a, b: a | b, terms)


def _carried(spark: SparkSession, folder: str, merged: DataFrame, at: str, idle_ms: int | None) -> DataFrame | None:
    """State of the batch's keys before the batch, columns ``__c_*``; None if nothing is stored yet."""
    if bucketed.manifest(spark, folder).schema is None:
        return None
    firsts = merged.groupBy(_KEY).agg(F.min(at).alias("__first"))
    state = bucketed.read_ids(spark, folder, firsts.select(_KEY)).withColumnsRenamed({name: f"__c_{name}" for name in _STATE})
    if idle_ms is not None:
        awake = F.coalesce(F.col("__first") - F.col("__c_seen") <= idle_ms, F.lit(True))
        state = state.join(firsts, _KEY).filter(awake).drop("__first")
    return state


def _throttled(both: DataFrame, at: str, tie: str, period: int) -> DataFrame:
    """Rows that the throttle lets through behind the inherited mark, or that another rule forces."""
    # a late row counts as of the mark, so that no mark goes back; the mark itself goes first, as a row that is always emitted
    effective = F.when(F.col(at).isNotNull(), F.greatest(F.col(at), F.col("__c_mark")))
    slim = both.select(_KEY, F.timestamp_millis(effective).alias("__when"), at, tie, F.col("__keep").alias("__force"))
    seeds = both.filter(F.col("__c_mark").isNotNull()).groupBy(_KEY).agg(F.first("__c_mark").alias("m"))
    nothing = [F.lit(None).cast(both.schema[name].dataType).alias(name) for name in (at, tie)]
    seeds = seeds.select(_KEY, F.timestamp_millis("m").alias("__when"), *nothing, F.lit(True).alias("__force"))
    kept = throttle(slim.unionByName(seeds), [_KEY], ["__when", at, tie], period, F.col("__force"))
    return null_safe_join(both, kept.filter(F.col(at).isNotNull()).select(_KEY, at, tie), [_KEY, at, tie], "left_semi")


def merge_into(
    folder: str,
    keys: Sequence[str],
    at: str,
    value: str,
    tie: str,
    handle: Callable[[DataFrame, int], None],
    rules: Rules = Rules(),
    idle_ms: int | None = None,
    chunks: int | None = None,
    buckets: int = 64,
) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: ``handle`` gets the merged rows that the rules let through, with the columns of the batch and ``merge_count``,
    ``merge_sum``, ``pair_min`` and ``pair_max``; ``folder`` keeps the state of the keys.

    Rows of a micro-batch come in ``(at, tie)`` order, unique within a key; ``at`` is in milliseconds. Later micro-batches come after earlier
    ones; a late row counts for the throttle as if it came at the key's last emission. Null values add nothing to sums and extremes, null keys
    are a key, rows without a time are emitted by rules without memory only where there is no throttle. ``idle_ms``: a key with no row
    for longer starts anew; ``forget`` removes such states. ``handle`` runs before the state switches: a batch run again after a failure
    hands out the same rows under the same number, one run again after its end nothing.
    """

    def step(df: DataFrame, batch_id: int) -> None:
        spark, query = df.sparkSession, query_of(df)
        store = bucketed.manifest(spark, folder) or bucketed.create(spark, folder, _KEY, buckets)
        if query in store.marks and batch_id <= store.marks[query]:
            return
        key = F.to_json(F.array(*[F.col(f"`{name}`").cast("string") for name in keys]))
        source = df.withColumns({_KEY: key, "__value": F.col(f"`{value}`").cast("double")})
        values = {
            "merge_count": Running("count"),
            "merge_sum": Running("sum", F.coalesce(F.col("__value"), F.lit(0.0))),
            "__previous": Running("previous", F.col("__value")),
        }
        merged = running(source, [_KEY], [at, tie], values, chunks)
        state = _carried(spark, folder, merged, at, idle_ms)
        if state is None:
            both = merged.withColumns(
                {f"__c_{name}": F.lit(None).cast("double" if name in ("total", "last") else "bigint") for name in _STATE}
            )
        else:
            both = merged.join(state, _KEY, "left")
        previous = F.coalesce(F.col("__previous"), F.col("__c_last"))
        both = both.withColumns(
            {
                "merge_count": F.col("merge_count") + F.coalesce(F.col("__c_count"), F.lit(0)),
                "merge_sum": F.col("merge_sum") + F.coalesce(F.col("__c_total"), F.lit(0.0)),
                "pair_min": F.least(previous, F.col("__value")),
                "pair_max": F.greatest(previous, F.col("__value")),
            }
        ).withColumn("__keep", _by_rule(rules, F.col("__value")))
        both = written(both, "merged")  # read for the rows let through, their throttle and the new state
        # the throttle's rows are written, since both ``handle`` and the new marks read them
        kept = both.filter("__keep") if rules.every_ms is None else written(_throttled(both, at, tie, rules.every_ms), "kept")
        handle(kept.select(*[F.col(f"`{name}`") for name in df.columns], *_MERGED), batch_id)

        known = F.when(F.col("__value").isNotNull(), F.col("merge_count"))
        after = both.groupBy(_KEY).agg(
            F.max("merge_count").alias("count"),
            F.max_by("merge_sum", "merge_count").alias("total"),
            F.coalesce(F.max_by("__value", known), F.first("__c_last")).alias("last"),
            F.first("__c_mark").alias("__old_mark"),
            F.greatest(F.max(at), F.first("__c_seen")).alias("seen"),
        )
        marks = kept.groupBy(_KEY).agg(F.max(at).alias("__new_mark"))
        after = after.join(marks, _KEY, "left").withColumn("mark", F.greatest("__old_mark", "__new_mark"))
        bucketed.change(spark, folder, after.select(_KEY, *_STATE), marks={query: batch_id})

    return step


def forget(spark: SparkSession, folder: str, before_ms: int) -> None:
    """Remove the state of keys whose last row came before a time; only their buckets are written."""
    idle = bucketed.read(spark, folder).filter(F.col("seen") < before_ms)
    bucketed.change(spark, folder, delete=idle)
