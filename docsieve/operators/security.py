"""Row and bucket permissions as filters and semi joins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docsieve.functions.ids import permission


def holds_any(row_permission: Column, held: Sequence[str]) -> Column:
    """The principal's own permission list as one predicate.

    Permissions are ``:``-separated parts; ``*`` stands for any part, ``a,b`` for either, and a permission covers everything
    that has further parts.
    """
    if not held:
        return F.lit(False)
    return row_permission.rlike("^(?:" + "|".join(_permission_body(text) for text in held) + ")(:.*)?$")


def _permission_body(text: str) -> str:
    parts = text.split(":")
    while len(parts) > 1 and parts[-1] == "*":
        parts.pop()
    choices = lambda part: "|".join(re.escape(choice).replace(r"\*", "[^:]*") for choice in part.split(","))
    return ":".join(f"(?:{choices(part)})" for part in parts)


def _permission_regex_column(grant: Column) -> Column:
    """The same for a column of permissions."""
    body = F.regexp_replace(grant, r"(:\*)+$", "")
    escaped = F.regexp_replace(body, r"([.\\+^$|()\[\]{}?])", r"\\$1")
    either = F.translate(F.regexp_replace(escaped, r"([^:]*,[^:]*)", "(?:$1)"), ",", "|")
    return F.concat(F.lit("^"), F.regexp_replace(either, r"\*", "[^:]*"), F.lit("(:.*)?$"))


def readable_rows(df: DataFrame, path: str, held: Sequence[str], root: str = "Bucket", action: str = "read") -> DataFrame:
    """Rows whose path permission the principal holds."""
    return df.filter(holds_any(permission(root, action, F.col(path)), held))


def authorized(df: DataFrame, permissions: Column, grants: DataFrame, principal: str) -> DataFrame:
    """Rows whose permission string the table ``grants(principal, permission)`` gives the principal.

    The distinct strings are matched, not the rows. A grant can only cover strings that start with its parts before the first
    wildcard, so the match is an equi-join on that start (a string has as many starts as parts), followed by the exact test.
    """
    start = F.regexp_replace(F.regexp_extract("permission", r"^((?:[^:*,]+(?::|$))*)", 1), ":$", "")
    held = grants.filter(F.col("principal") == principal).select(start.alias("__start"), _permission_regex_column(F.col("permission")).alias("__regex"))
    texts = df.select(permissions.alias("__text")).distinct()
    parts = F.split("__text", ":")
    starts = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda depth: F.array_join(F.slice(parts, 1, depth), ":"))
    candidates = texts.select("__text", F.explode(starts).alias("__start")).join(held.distinct(), "__start")
    allowed = candidates.filter(F.expr("__text RLIKE __regex")).select("__text").distinct()
    return df.join(allowed, permissions == F.col("__text"), "left_semi")


def doc_level(df: DataFrame, auths: str, held: Sequence[str]) -> DataFrame:
    """Document rights: rows whose authorization set meets the held one; rows without a set are open."""
    mine = F.array(*[F.lit(text) for text in held]) if held else F.array().cast("array<string>")
    return df.filter(F.col(auths).isNull() | F.arrays_overlap(F.col(auths), mine))


def field_level(df: DataFrame, rules: Mapping[str, Sequence[str]], held: Sequence[str]) -> DataFrame:
    """Field rights: a field whose set does not meet the held one is masked (null)."""
    masked = {name: F.lit(None).cast(df.schema[name].dataType) for name, needed in rules.items() if not set(needed) & set(held)}
    return df.withColumns(masked) if masked else df


def field_level_by_row(df: DataFrame, field_auths: str, fields: Sequence[str], held: Sequence[str]) -> DataFrame:
    """Field rights carried by each row as a map field -> set of rights."""
    mine = F.array(*[F.lit(text) for text in held]) if held else F.array().cast("array<string>")
    columns = {}
    for name in fields:
        needed = F.try_element_at(F.col(field_auths), F.lit(name))
        columns[name] = F.when(needed.isNull() | F.arrays_overlap(needed, mine), F.col(name))
    return df.withColumns(columns)
