"""Buckets: unions over bucket sets, glob joins between paths and patterns, lookups across buckets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docsieve.functions import globs
from docsieve.functions.timefn import let
from docsieve.operators.ordered import first_rows
from docsieve.operators.query import Query

BUCKET = "__bucket"


def matching_buckets(names: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Distinct bucket names any pattern matches (catalog on the driver)."""
    import re

    return sorted({name for name in names if any(re.match(globs.path_glob_regex(pattern), name) for pattern in patterns)})


def union_buckets(
    buckets: Mapping[str, DataFrame],
    patterns: Sequence[str] = ("/**",),
    extra: Callable[[str], Query | None] | None = None,
) -> DataFrame:
    """UNION ALL of the buckets the patterns match, with ``__bucket``; ``extra`` gives a further predicate per bucket.

    Sort and limit belong after the union, where they mean what they say.
    """
    out = None
    for name in matching_buckets(list(buckets), patterns):
        part = buckets[name]
        query = extra(name) if extra else None
        if query is not None:
            part = query.filter(part)
        part = part.withColumn(BUCKET, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise LookupError(f"no bucket matches {list(patterns)}")
    return out


def count_across(union: DataFrame) -> DataFrame:
    return union.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"))


def first_hit(union: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Per key, the row of the first bucket (in name order) that has it."""
    return first_rows(union, list(keys), [F.col(BUCKET).asc(), *[F.col(name).asc() for name in tie]])


_WILD = r"[?*\[{\\]"


def path_anchors(path: Column) -> Column:
    """Everything a pattern may be anchored at that this path offers: itself, its directories, its parts by position."""

    def offered(parts: Column) -> Column:
        depths = F.sequence(F.lit(1), F.size(parts))
        folders = F.transform(depths, lambda depth: F.concat(F.array_join(F.slice(parts, 1, depth - 1), "/"), F.when(depth > 1, "/").otherwise("")))
        places = F.transform(depths, lambda depth: F.concat(F.lit("#"), depth.cast("string"), F.lit(":"), F.get(parts, depth - 1)))
        return F.array_append(F.concat(folders, places), path)

    return F.array_distinct(let(F.split(path, "/"), offered))


def glob_anchor(pattern: Column) -> Column:
    """What every match of a pattern must offer.

    A literal pattern is itself; else its literal directory, if it names one; else its first literal part before any ``**``, by
    position (``/*/fr/*`` gives part 3 ``fr``); else nothing but the root. Sets may match a slash and choices hold one: parts behind them have
    no position.
    """

    def choose(parts: Column) -> Column:
        positions = F.sequence(F.lit(1), F.size(parts))
        # behind a crossing star, a set or a choice that is still open, parts have no certain position
        deep = F.array_position(F.transform(parts, lambda part: part.rlike(r"\*\*|\[|\{[^}]*$|\\")), True)
        literal = F.filter(
            positions,
            lambda at: F.get(parts, at - 1).rlike("^[^?*\\[{\\\\]+$") & ((deep == 0) | (at < deep)),
        )
        first = F.get(literal, F.lit(0))
        return F.when(first.isNotNull(), F.concat(F.lit("#"), first.cast("string"), F.lit(":"), F.get(parts, first - 1)))

    folder = F.regexp_extract(F.regexp_replace(pattern, f"(?s){_WILD}.*$", ""), r"^(.*/)?", 0)
    return (
        F.when(~pattern.rlike(_WILD), pattern)
        .when(F.length(folder) > 1, folder)
        .otherwise(F.coalesce(let(F.split(pattern, "/"), choose), folder))
    )


_GRAM = 3  # longest piece of literal text that patterns are filed under
_IN_PLACE = 256  # patterns of wildcards alone that a path tests in one expression


def _literal_runs(pattern: Column) -> Column:
    """Texts every match of a pattern holds: what stands between its wildcards, sets, choices and quoted characters."""
    special = r"(?s)\*+|\?|\[[^\]]*\]|\{[^}]*\}|\\."
    return F.filter(F.split(F.regexp_replace(pattern, special, "\0"), "\0"), lambda run: run.rlike("[^/]"))


def _pieces(text: Column, length: int) -> Column:
    """All pieces of ``length`` characters of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    pieces = F.transform(starts, lambda start: F.substring(text, start, F.lit(length)))
    return F.when(F.length(text) >= length, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _filed_pieces(pattern: Column) -> Column:
    """Pieces a pattern may be filed under: of its runs, the longest there are up to ``_GRAM``, and not of slashes alone."""

    def of(runs: Column) -> Column:
        out = F.array().cast("array<string>")
        for length in range(1, _GRAM + 1):
            found = F.array_distinct(F.filter(F.flatten(F.transform(runs, lambda run: _pieces(run, length))), lambda piece: piece.rlike("[^/]")))
            out = F.when(F.size(found) > 0, found).otherwise(out)
        return out

    return let(_literal_runs(pattern), of)


def _slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


def _join_by_pieces(paths: DataFrame, path: str, texts: DataFrame) -> DataFrame:
    """Path rows with ``__text`` and ``__regex`` of the ``texts`` that hold one of their pieces in common.

    Each text is filed under the one of its pieces that the fewest paths hold (then the smallest).
    """
    candidates = texts.withColumn("__piece", F.explode("__pieces")).drop("__pieces")
    lengths = [row["n"] for row in candidates.select(F.length("__piece").alias("n")).distinct().collect()]  # at most _GRAM numbers
    column = F.col(f"`{path}`")
    offered = F.flatten(F.array(*[_pieces(column, length) for length in sorted(lengths)])) if lengths else F.array().cast("array<string>")
    wanted = candidates.select("__piece").distinct()
    counts = paths.select(F.explode(offered).alias("__piece")).join(wanted, "__piece", "left_semi").groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    # a piece no path holds is the rarest: its text matches nothing
    ranked = candidates.join(counts, "__piece", "left").groupBy("__text", "__regex").agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__piece").alias("piece"))).alias("__least")
    )
    filed = ranked.filter(F.col("__least.n") > 0).select("__text", "__regex", F.col("__least.piece").alias("__piece"))
    return paths.withColumn("__piece", F.explode(offered)).join(filed, "__piece").drop("__piece")


def _join_in_place(paths: DataFrame, path: str, texts: DataFrame) -> DataFrame:
    """Path rows with ``__text`` of the ``texts`` they match, tested in blocks of about ``_IN_PLACE`` texts.

    A path is copied to each block, which is one as long as the count allows; no task and no row holds more than a block.
    """
    blocks = -(-texts.count() // _IN_PLACE)
    if blocks == 0:
        return paths.limit(0).withColumn("__text", F.lit(None).cast("string"))
    column = F.col(f"`{path}`")
    numbered = texts.withColumn("__block", F.pmod(F.xxhash64("__text"), F.lit(blocks)))
    sets = numbered.groupBy("__block").agg(F.collect_list(F.struct(F.col("__text").alias("p"), F.col("__regex").alias("r"))).alias("__set"))
    copied = paths.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    tested = F.filter("__set", lambda t: (column == t["p"]) | F.call_function("regexp_like", column, t["r"]))
    return copied.join(sets, "__block").withColumn("__text", F.explode(F.transform(tested, lambda t: t["p"]))).drop("__set", "__block")


def _join_free(paths: DataFrame, path: str, free: DataFrame, pattern: str) -> DataFrame:
    """Pairs of paths and patterns without a literal folder or part."""
    texts = free.select(F.col(f"`{pattern}`").alias("__text"), "__regex").distinct().withColumn("__pieces", _filed_pieces(F.col("__text")))
    column, text = F.col(f"`{path}`"), F.col("__text")
    exact = (column == text) | F.expr("`{}` RLIKE __regex".format(path))

    with_piece = texts.filter(F.size("__pieces") > 0)
    by_piece = _join_by_pieces(paths, path, with_piece).filter(exact).drop("__regex")
    bare = texts.filter(F.size("__pieces") == 0).drop("__pieces")
    # without **, sets and choices, a match has as many slashes as the pattern
    fixed = ~text.rlike(r"\*\*|[\[{]")
    depths = bare.filter(fixed).withColumn("__depth", _slashes(text))
    by_depth = paths.withColumn("__depth", _slashes(column)).join(depths, "__depth").filter(exact).drop("__depth", "__regex")
    in_place = _join_in_place(paths, path, bare.filter(~fixed))
    found = by_piece.unionByName(by_depth).unionByName(in_place)
    return found.join(free.drop("__want", "__regex"), F.col("__text") == F.col(f"`{pattern}`")).drop("__text")


def glob_join(paths: DataFrame, path: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """All (path row, pattern row) pairs that match; nulls match nothing.

    The join is an equi-join on the anchor of the pattern, followed by the exact test, so a path only meets the patterns that
    share a directory or a part with it. Patterns without any literal folder or part (``/a*``, ``/**/x*``) are filed under the rarest
    short piece of literal text they hold, which a path's own pieces look up. Of patterns of wildcards alone, those that fix the number of
    folders (``/*/*``) are looked up by it; the others (``/**``) fit nearly every path and are tested in place, in blocks.
    """
    marked = patterns.withColumns({"__want": glob_anchor(F.col(pattern)), "__regex": globs.path_glob_regex_column(F.col(pattern))})
    anchored = marked.filter(F.length("__want") > 1)
    left = paths.withColumn("__anchor", F.explode(path_anchors(F.col(path))))
    joined = left.join(anchored, F.col("__anchor") == F.col("__want"))
    exact = (F.col(path) == F.col(pattern)) | F.expr(f"`{path}` RLIKE __regex")
    near = joined.filter(exact).drop("__anchor", "__want", "__regex")

    free = marked.filter(F.length("__want") <= 1)
    if free.isEmpty():
        return near
    return near.unionByName(_join_free(paths, path, free, pattern))


def expand_patterns(catalog: DataFrame, path: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Distinct catalog rows at least one pattern matches."""
    hits = glob_join(catalog.select(path), path, patterns, pattern).select(path).distinct()
    return catalog.join(hits, path, "left_semi").dropDuplicates([path])


def table_view(df: DataFrame, name: str) -> str:
    """Register a bucket as a temporary view under its signature; returns the view name."""
    import hashlib

    view = "b_" + "".join(char if char.isalnum() else "_" for char in name.lower()).strip("_") + "_" + hashlib.md5(name.encode()).hexdigest()[20:]
    df.createOrReplaceTempView(view)
    return view


def coerce(df: DataFrame, table_format: T.StructType) -> DataFrame:
    """Rows as a declared table: columns missing in the rows are null, values that do not fit are null."""
    return df.select(
        *[
            (F.col(f"`{field.name}`").try_cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)).alias(field.name)
            for field in table_format.fields
        ]
    )
