"""Keyed deduplication of incoming rows against stored rows.

Policies ``leave``, ``update`` and ``overwrite`` are native joins. Both sides shrink to one row per key before they meet, with
map-side work on each (a row-number limit on the incoming side, partial aggregation on the stored side), so a key that holds a
large share of either side costs each task one row. Window, aggregate and join all use the one column ``__key``: one shuffle
per side.

``custom`` and ``custom_update`` hand groups to a user function, see ``custom_groups``.

Where a key matches several stored rows the incoming row must be newer than all of them for ``update``, and it takes the
smallest ``(bucket, _id)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docsieve.functions import globs, paths
from docsieve.functions.timefn import flexible_timestamp
from docsieve.operators.grouped import GroupReducer, finish_groups, grouped_apply, reduce_groups, reduce_rows
from docsieve.operators.ordered import first_rows, null_safe_join
from docsieve.operators.query import include_fields
from docsieve.session import written

_KEY_NAME = re.compile(r"k\d+")
POLICIES = ("leave", "update", "overwrite", "custom", "custom_update")
EMISSION_POLICIES = ("lax", "strict", "very_strict")


@dataclass(frozen=True)
class DedupConfig:
    """How to deduplicate. With no policy, no fields and no contexts given, deduplication is off and every row passes.

    ``order`` names the columns that give arrival order within a key (unique together); it is required.
    ``contexts`` are bucket globs limiting the stored rows looked at, through their ``bucket`` column.
    """

    order: tuple[str, ...]
    policy: str | None = None
    fields: tuple[str, ...] | None = None
    contexts: tuple[str, ...] = ()
    timestamp: str = "__a.tp"
    emission: str = "strict"
    finalize_all: bool = False
    delete_unhandled: bool | None = None
    id_column: str = "_id"
    bucket_column: str = "__bucket"

    @property
    def disabled(self) -> bool:
        return self.policy is None and not self.fields and not self.contexts

    def resolved(self) -> "DedupConfig":
        policy = self.policy or "leave"
        if policy not in POLICIES or self.emission not in EMISSION_POLICIES:
            raise ValueError(f"unknown policy: {policy}/{self.emission}")
        if not self.order:
            raise ValueError("arrival order columns are required")
        delete = self.emission == "very_strict" if self.delete_unhandled is None else self.delete_unhandled
        return replace(self, policy=policy, fields=self.fields or (self.id_column,), delete_unhandled=delete)


def dedup_key(df: DataFrame, fields: Sequence[str]) -> Column:
    """Key of the dotted fields: the value itself for one field, else a struct.

    Struct equality treats two missing members as equal; a plain column sorts and hashes faster.
    """
    if len(fields) == 1:
        return paths.key_value_at(df.schema, fields[0])
    return F.struct(*[paths.value_at(df.schema, name).alias(f"k{index}") for index, name in enumerate(fields)])


def keyed(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows with ``__key``; rows that have none of the fields are dropped."""
    out = df.withColumn("__key", dedup_key(df, fields))
    if len(fields) == 1:
        return out.filter(F.col("__key").isNotNull())
    present = F.lit(False)
    for index in range(len(fields)):
        present = present | F.col(f"__key.k{index}").isNotNull()
    return out.filter(present)


def keep_last(df: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last arrival per key."""
    if not order:
        raise ValueError("arrival order columns are required")
    last = first_rows(keyed(df, fields), ["__key"], [F.col(name).desc_nulls_last() for name in order])
    return last.drop("__key")


def lookup_scope(stored: DataFrame, config: DedupConfig) -> DataFrame:
    """Stored rows in the buckets the contexts name."""
    if not config.contexts:
        return stored
    return stored.filter(globs.matches_path(F.col(config.bucket_column), list(config.contexts)))


def lookup_fields(config: DedupConfig) -> list[str] | None:
    """Stored fields a policy reads: id and keys, with the time where times are compared; None means all of them."""
    config = config.resolved()
    if config.policy in ("custom", "custom_update"):
        return None
    timed = [config.timestamp] if config.policy == "update" else []
    return list(dict.fromkeys([config.id_column, *timed, *config.fields]))


def lookup(incoming: DataFrame, stored: DataFrame, config: DedupConfig) -> DataFrame:
    """Stored rows in scope whose key occurs in the batch, with the fields the policy reads."""
    config = config.resolved()
    scope = keyed(lookup_scope(stored, config), config.fields)
    keys = keyed(incoming, config.fields).select("__key").distinct()
    found = scope.join(keys, "__key", "left_semi").drop("__key")
    fields = lookup_fields(config)
    return found if fields is None else include_fields(found, fields)


def _timestamp(df: DataFrame, path: str) -> Column:
    found = paths.locate(df.schema, path)
    return F.lit(None).cast("timestamp_ntz") if found is None else flexible_timestamp(found[0], found[1].simpleString())


def _stored_rows(stored: DataFrame, config: DedupConfig) -> DataFrame:
    """Minimal projection of the stored rows: key, id, bucket and, where compared, time."""
    rows = keyed(stored, config.fields)
    bucket = F.col(config.bucket_column) if config.bucket_column in stored.columns else F.lit("")
    columns = ["__key", F.col(config.id_column).alias("__old_id"), bucket.alias("__old_bucket")]
    if config.policy in ("update", "custom_update"):
        columns.append(_timestamp(rows, config.timestamp).alias("__old_ts"))
    return rows.select(*columns)


def _match_summary(old: DataFrame, timed: bool, with_id: bool = True) -> DataFrame:
    """One row per stored key: how many rows match, the id to take over, and the newest time if all times are readable.

    Without the id the aggregate buffers have fixed width and Spark hashes instead of sorting.
    """
    aggregates = [F.count(F.lit(1)).alias("__old_count")]
    if with_id:
        aggregates.append(F.min(F.struct("__old_bucket", "__old_id")).alias("__first"))
    if timed:
        aggregates.append(F.when(F.count("__old_ts") == F.count(F.lit(1)), F.max("__old_ts")).alias("__old_ts"))
    return old.groupBy("__key").agg(*aggregates)


@dataclass(frozen=True)
class DedupResult:
    """``emit``: rows to write (a replacement carries the stored id); ``delete``: ids to remove; ``errors``: refused rows."""

    emit: DataFrame
    delete: DataFrame
    errors: DataFrame | None = None
    stats: DataFrame | None = None


def dedup(incoming: DataFrame, stored: DataFrame, config: DedupConfig, small_batch: bool = False) -> DedupResult:
    """Native policies. ``small_batch`` cuts the stored side to the batch's keys before anything else; Spark picks the join by size."""
    if config.disabled:
        return DedupResult(incoming, stored.select(config.id_column).limit(0))
    config = config.resolved()
    if config.policy not in ("leave", "update", "overwrite"):
        raise ValueError("custom policies need dedup_custom")
    last = first_rows(keyed(incoming, config.fields), ["__key"], [F.col(name).desc_nulls_last() for name in config.order])
    scope = lookup_scope(stored, config)
    old = _stored_rows(scope, config)
    if small_batch:
        old = old.join(keyed(incoming, config.fields).select("__key").distinct(), "__key", "left_semi")
    if config.policy == "leave":
        emit = last.join(old.select("__key").distinct(), "__key", "left_anti").drop("__key")
        return DedupResult(emit, old.select(F.col("__old_id").alias(config.id_column)).limit(0))
    matched = last.join(_match_summary(old, config.policy == "update"), "__key", "left")
    if config.policy == "update":
        newer = F.coalesce(_timestamp(last, config.timestamp) > F.col("__old_ts"), F.lit(False))
        matched = matched.filter(F.col("__old_count").isNull() | newer)
    id_column = F.coalesce(F.col("__first.__old_id"), F.col(config.id_column))
    emit = matched.withColumn(config.id_column, id_column).select(*incoming.columns)
    delete = old.select(F.col("__old_id").alias(config.id_column)).limit(0)
    if config.delete_unhandled:
        replaced = matched.filter(F.col("__old_count") > 1).select("__key", "__first")
        delete = (
            old.join(replaced, "__key")
            .filter(F.struct("__old_bucket", "__old_id") > F.col("__first"))
            .select(F.col("__old_id").alias(config.id_column))
        )
    return DedupResult(emit, delete)


def dedup_stats(incoming: DataFrame, stored: DataFrame, config: DedupConfig) -> DataFrame:
    """One row of counts: keys still emitted, keys matched, incoming and stored rows of matched keys, deleted rows.

    Keys that stay (a replaced key included) count as ``nonduplicate_keys``.
    """
    config = config.resolved()
    timed = config.policy in ("update", "custom_update")
    new = keyed(incoming, config.fields)
    per_key = new.groupBy("__key").agg(
        F.count(F.lit(1)).alias("__new_count"),
        F.max_by(_timestamp(new, config.timestamp) if timed else F.lit(None), F.struct(*config.order)).alias("__new_ts"),
    )
    old = _match_summary(_stored_rows(lookup_scope(stored, config), config), timed, with_id=False)
    both = per_key.join(old, "__key", "left").withColumn("__hit", F.col("__old_count").isNotNull())
    if config.policy == "leave":
        kept = ~F.col("__hit")
    elif config.policy == "overwrite":
        kept = F.lit(True)
    elif config.policy == "update":
        kept = ~F.col("__hit") | F.coalesce(F.col("__new_ts") > F.col("__old_ts"), F.lit(False))
    else:
        kept = ~F.col("__hit")
    deleted = F.when(F.col("__hit") & kept, F.col("__old_count") - 1) if config.delete_unhandled else F.lit(0)
    zero = F.lit(0).cast("bigint")
    return both.agg(
        F.count_if(kept).cast("bigint").alias("nonduplicate_keys"),
        F.count_if("__hit").cast("bigint").alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("__hit"), F.col("__new_count"))), zero).alias("duplicates_incoming"),
        F.coalesce(F.sum(F.when(F.col("__hit"), F.col("__old_count"))), zero).alias("duplicates_existing"),
        F.coalesce(F.sum(deleted), zero).cast("bigint").alias("deleted"),
    )


# user functions ---------------------------------------------------------------------------------------------------


def chosen_keys(incoming: DataFrame, stored: DataFrame, config: DedupConfig) -> DataFrame:
    """(``__key``, ``__batch_size``): the groups a custom policy hands to its function, with the number of new rows of matched ones.

    ``custom`` takes every matched key, ``custom_update`` those whose last new row is newer than every stored one, and
    ``finalize_all`` adds the unmatched keys. Both sides are one row per key before they meet.
    """
    config = config.resolved()
    new = keyed(incoming, config.fields)
    timed = config.policy == "custom_update"
    summary = _match_summary(_stored_rows(lookup_scope(stored, config), config), timed, with_id=False)
    per_key = [F.count(F.lit(1)).alias("__new_count")]
    if timed:
        per_key.append(F.max_by(_timestamp(new, config.timestamp), F.struct(*config.order)).alias("__new_ts"))
    decided = new.groupBy("__key").agg(*per_key).join(summary, "__key", "left")
    matched = F.col("__old_count").isNotNull()
    passes = matched
    if timed:
        passes = passes & F.coalesce(F.col("__new_ts") > F.col("__old_ts"), F.lit(False))
    if config.finalize_all:
        passes = passes | ~matched
    return decided.filter(passes).select("__key", F.when(matched, F.col("__new_count")).alias("__batch_size"))


def _both_sides(incoming: DataFrame, stored: DataFrame, config: DedupConfig) -> DataFrame:
    new = keyed(incoming, config.fields).withColumn("__injected", F.lit(False))
    return new.unionByName(keyed(lookup_scope(stored, config), config.fields).withColumn("__injected", F.lit(True)), allowMissingColumns=True)


def custom_groups(incoming: DataFrame, stored: DataFrame, config: DedupConfig) -> DataFrame:
    """Rows of the ``chosen_keys``: ``__injected`` is false for new rows and true for stored ones."""
    config = config.resolved()
    return _both_sides(incoming, stored, config).join(chosen_keys(incoming, stored, config), "__key")


def passed_through(incoming: DataFrame, stored: DataFrame, config: DedupConfig) -> DataFrame:
    """Unmatched keys' last rows, which a custom policy emits without calling the function (none when finalizing all)."""
    config = config.resolved()
    if config.finalize_all:
        return incoming.limit(0)
    return dedup(incoming, stored, replace(config, policy="leave", delete_unhandled=False)).emit


def group_columns(groups: DataFrame) -> DataFrame:
    """Custom groups with the key as plain columns ``k0``, ``k1``, ... in place of ``__key``."""
    key_type = groups.schema["__key"].dataType
    if isinstance(key_type, T.StructType):
        keys = [F.col(f"__key.{name}").alias(name) for name in key_type.fieldNames()]
    else:
        keys = [F.col("__key").alias("k0")]
    return groups.select(*keys, *[F.col(f"`{name}`") for name in groups.columns if name != "__key"])


def custom_reduce(
    groups: DataFrame,
    reducer: type[GroupReducer],
    reduced_schema: T.StructType | str,
    schema: T.StructType | str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Custom policy as a ``GroupReducer`` over key columns ``k0``, ``k1``, ...: hot keys are reduced before the shuffle.

    ``columns`` names what the reducer reads; Spark cannot see into it, so naming them is what keeps the rest unread.
    """
    flat = group_columns(groups)
    keys = [name for name in flat.columns if _KEY_NAME.fullmatch(name)]
    rows = flat if columns is None else flat.select(*keys, *[name for name in columns if name not in keys])
    return reduce_groups(rows, keys, reducer, reduced_schema, schema)


def dedup_custom(
    incoming: DataFrame,
    stored: DataFrame,
    config: DedupConfig,
    reducer: type[GroupReducer],
    reduced_schema: T.StructType | str,
    schema: T.StructType | str,
    columns: Sequence[str] | None = None,
) -> DedupResult:
    """A custom policy from end to end.

    Rows of both sides are reduced where they are read; of the reduced rows those of the ``chosen_keys`` go on to the function, whose
    rows are written once, each with its group and its place in it. Against that table the emission policy of ``config`` is checked and
    the deletions are worked out, by joins on group and id, so that a group of many stored rows is never in one place.

    ``emit``: accepted rows and, untouched, the last row of each unmatched key (fields the one has and the other has not are null).
    ``delete``: ids of accepted rows with nothing but an id and, with ``delete_unhandled``, ids of stored rows of the function's groups
    that it did not write again. ``errors``: refused rows. ``columns`` names what the reducer reads beside the keys.
    """
    config = config.resolved()
    chosen = written(chosen_keys(incoming, stored, config).select("__key"), "chosen")
    flat = group_columns(_both_sides(incoming, stored, config))
    keys = [name for name in flat.columns if _KEY_NAME.fullmatch(name)]
    wanted = columns if columns is not None else [name for name in flat.columns if name not in keys]
    reduced = reduce_rows(flat.select(*keys, *[name for name in wanted if name not in keys]), reducer, reduced_schema)
    reduced = null_safe_join(reduced, group_columns(chosen), keys, "left_semi")
    made = written(finish_groups(reduced, keys, reducer, schema, tagged=True), "emissions")

    single = not isinstance(chosen.schema["__key"].dataType, T.StructType)
    group = F.col("__g_k0") if single else F.struct(*[F.col(f"__g_{name}").alias(name) for name in keys])
    emitted = made.withColumn("__key", group).drop(*[f"__g_{name}" for name in keys])
    members = keyed(lookup_scope(stored, config), config.fields).select("__key", config.id_column)
    members = members.join(chosen, "__key", "left_semi")
    own = dedup_key(emitted, config.fields)
    checked = check_emissions(emitted, members, own, config.emission, ["__n"], config.id_column, "__key", config.delete_unhandled)
    payload = [field.name for field in made.schema.fields if not field.name.startswith("__g_") and field.name != "__n"]
    passed = checked.filter(F.col("__ok") & (F.col("__action") == "write")).select(*[F.col(f"`{name}`") for name in payload])
    refused = checked.filter(~F.col("__ok")).select(*[F.col(f"`{name}`") for name in payload])
    emit = passed.unionByName(passed_through(incoming, stored, config), allowMissingColumns=True)
    return DedupResult(emit, unhandled_ids(checked, members, config.delete_unhandled, config.id_column), refused)


def custom_apply(groups: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Custom policy as any function ``fn(key, frames)`` over one group at a time, streamed in Arrow batches."""
    flat = group_columns(groups)
    return grouped_apply(flat, [name for name in flat.columns if _KEY_NAME.fullmatch(name)], fn, schema)


def check_emissions(
    emitted: DataFrame,
    members: DataFrame,
    own_key: Column,
    policy: str,
    order: Sequence[str],
    id_column: str = "_id",
    group_column: str = "__key",
    delete_unhandled: bool = False,
) -> DataFrame:
    """Emitted rows with ``__ok`` and ``__action`` (``write`` or ``delete``).

    ``emitted`` carries the key of the group it came from in ``group_column``; ``members`` has the stored ids of each group in
    ``(group_column, id_column)``. A row with nothing but an id asks for deletion. ``strict`` refuses a row whose id is not in
    the group unless its own key differs (with ``delete_unhandled`` an id counts once); ``very_strict`` accepts one written row per
    group, and anything up to it.
    """
    payload = [name for name in emitted.columns if name not in (id_column, group_column, *order)]
    only_id = F.col(id_column).isNotNull()
    for name in payload:
        only_id = only_id & F.col(f"`{name}`").isNull()
    rows = emitted.withColumn("__action", F.when(only_id, "delete").otherwise("write"))
    if policy == "lax":
        return rows.withColumn("__ok", F.lit(True))
    # minima per group stand in for windows: only the position of a first written row matters
    position = F.struct(*order)
    writes = rows.filter(F.col("__action") == "write")
    if policy == "strict":
        ids = members.select(F.col(group_column).alias("__g"), F.col(id_column).alias("__i")).distinct().withColumn("__in", F.lit(True))
        if delete_unhandled:
            firsts = writes.groupBy(F.col(group_column).alias("__g"), F.col(id_column).alias("__i")).agg(F.min(position).alias("__first"))
            ids = ids.join(firsts, ["__g", "__i"], "left")
        else:
            ids = ids.withColumn("__first", F.lit(None))
        tagged = rows.withColumn("__own", own_key)
        joined = tagged.join(ids, (tagged[group_column] == F.col("__g")) & (tagged[id_column] == F.col("__i")), "left")
        known = F.col("__in").isNotNull()
        if delete_unhandled:
            known = known & (F.col("__first").isNull() | (position <= F.col("__first")))
        ok = known | ~F.col("__own").eqNullSafe(F.col(group_column))
        return joined.withColumn("__ok", ok).drop("__g", "__i", "__in", "__own", "__first")
    first = writes.groupBy(F.col(group_column).alias("__g")).agg(F.min(position).alias("__first"))
    joined = rows.join(first, rows[group_column] == F.col("__g"), "left")
    return joined.withColumn("__ok", F.col("__first").isNull() | (position <= F.col("__first"))).drop("__g", "__first")


def unhandled_ids(
    checked: DataFrame, members: DataFrame, delete_unhandled: bool, id_column: str = "_id", group_column: str = "__key"
) -> DataFrame:
    """Ids to delete: those asked for, plus, with ``delete_unhandled``, stored ids of a group not written again."""
    asked = checked.filter(F.col("__ok") & (F.col("__action") == "delete")).select(id_column)
    if not delete_unhandled:
        return asked
    writes = checked.filter(F.col("__ok") & (F.col("__action") == "write")).select(group_column, id_column).distinct()
    left = members.select(group_column, id_column).join(writes, [group_column, id_column], "left_anti").select(id_column)
    return asked.unionByName(left).distinct()
