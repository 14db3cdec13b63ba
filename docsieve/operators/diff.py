"""Differences between versions, change thresholds, rule trees and dependency joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def record_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Per key a map field -> changed. A field only one version has counts as changed wherever it is set."""
    names = list(fields or dict.fromkeys([*old.columns, *new.columns]))
    names = [name for name in names if name != key]
    left = old.select(F.col(key).alias("__old_key"), *[F.col(name).alias(f"__old_{name}") for name in names if name in old.columns])
    right = new.select(F.col(key).alias("__new_key"), *[F.col(name).alias(f"__new_{name}") for name in names if name in new.columns])
    both = left.join(right, F.col("__old_key") == F.col("__new_key"), "full_outer")

    def side(frame: DataFrame, prefix: str, name: str) -> Column:
        return F.col(prefix + name) if name in frame.columns else F.lit(None)

    changed = {name: ~side(old, "__old_", name).eqNullSafe(side(new, "__new_", name)) for name in names}
    entries = [part for name, column in changed.items() for part in (F.lit(name), column)]
    return both.select(F.coalesce("__old_key", "__new_key").alias(key), F.create_map(*entries).alias("changed"))


def resource_sizes(df: DataFrame, resource: str, size: Column | None = None) -> DataFrame:
    """Current size of each resource: its rows, or the sum of a size column."""
    total = F.count(F.lit(1)) if size is None else F.sum(size)
    return df.groupBy(F.col(resource).alias("resource")).agg(total.alias("current"))


def changed_beyond(current: DataFrame, last: DataFrame, limit: Column | int = 0) -> DataFrame:
    """Resources that grew by more than the limit since the last snapshot; both sizes must be known."""
    joined = current.join(last, "resource")
    bound = F.coalesce(limit, F.lit(0)) if isinstance(limit, Column) else F.lit(limit)
    return joined.filter((F.col("current") - F.col("last")) > bound)


def rule_tree(rule: Mapping[str, Any], fired: Column, pass_if_disabled: bool = True) -> Column:
    """Condition over an array of fired resources.

    A leaf is ``{"resource": r}``; a node is ``{"op": "and"|"or"|"not", "rules": [...]}``. A disabled child (``enabled: False``)
    counts as true under and/or and as false under not.
    """
    if rule.get("enabled") is False:
        return F.lit(pass_if_disabled)
    op = rule.get("op")
    if op is None:
        return F.array_contains(fired, rule["resource"])
    children = [rule_tree(child, fired, op != "not") for child in rule.get("rules", ())]
    if op == "and":
        return reduce(lambda a, b: a & b, children, F.lit(True))
    any_child = reduce(lambda a, b: a | b, children, F.lit(False))
    return any_child if op == "or" else ~any_child


def rule_resources(rule: Mapping[str, Any]) -> list[str]:
    """Resources a rule tree mentions."""
    if rule.get("op") is None:
        return [rule["resource"]] if "resource" in rule else []
    return sorted({name for child in rule.get("rules", ()) for name in rule_resources(child)})


def satisfied(fired: DataFrame, keys: Sequence[str], resource: str, rule: Mapping[str, Any]) -> DataFrame:
    """Per key, whether the rule holds for the set of resources fired. Only resources the rule mentions are collected."""
    named = F.when(F.col(resource).isin(rule_resources(rule)), F.col(resource))
    sets = fired.groupBy(*keys).agg(F.collect_set(named).alias("__fired"))
    return sets.select(*keys, rule_tree(rule, F.col("__fired")).alias("satisfied"))


def dependents(completed: DataFrame, dependencies: DataFrame, finished: str, needs: str) -> DataFrame:
    """Dependency rows whose input has completed."""
    done = completed.select(F.col(finished).alias("__done")).distinct()
    return dependencies.join(done, F.col(needs) == F.col("__done"), "left_semi")


def group_pages(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, page_rows: int = 1000, chunks: int | None = None) -> DataFrame:
    """Rows of a key tuple grouped into lists of at most ``page_rows`` items in order: (keys, page, items).

    A group of any size becomes as many rows as it has pages; nothing is cut off and no list grows without bound.
    """
    from docsieve.operators.ordered import Running, running

    numbered = running(df.withColumn("__item", item), keys, order, {"__number": Running("count")}, chunks)
    page = F.floor((F.col("__number") - 1) / page_rows).cast("bigint")
    listed = numbered.groupBy(*keys, page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("__number", "__item"))).alias("__rows"))
    return listed.select(*keys, "page", F.transform("__rows", lambda row: row["__item"]).alias("items"))
