"""Keyed merges of log and event rows, running merges, and the rules that decide which merged rows are emitted."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docsieve.functions.timefn import millis
from docsieve.operators.grouped import each_group, group_starts, sorted_groups, sorted_pieces
from docsieve.operators.ordered import CHUNK, CUT, Running, in_chunks, null_safe_join, running
from docsieve.operators.query import outside_threshold
from docsieve.session import ensure_checkpoint_dir, written

# group merges: aggregate expressions, all combined map-side ----------------------------------------------------------


def latest(value: Column, order: Sequence[str]) -> Column:
    """Newest row's value."""
    return F.max_by(value, F.struct(*order))


def merge_count() -> Column:
    return F.count(F.lit(1))


def merge_sum(value: Column) -> Column:
    """Sum with a missing value counting as 0."""
    return F.sum(F.coalesce(value.cast("double"), F.lit(0.0)))


def merge_min(value: Column) -> Column:
    return F.min(value)


def merge_max(value: Column) -> Column:
    return F.max(value)


def merge(df: DataFrame, keys: Sequence[str], merges: Mapping[str, Column]) -> DataFrame:
    """A chain of merges per key in one pass: each entry of ``merges`` is one aggregate expression."""
    return df.groupBy(*keys).agg(*[column.alias(name) for name, column in merges.items()])


def append_pieces(df: DataFrame, keys: Sequence[str], message: str, order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """(keys, piece, text): the messages of a key joined by blanks, newest first, as consecutive pieces, the newest being piece 0.

    A piece holds the messages of one chunk of the table, so no text grows with its key. Null messages are left out.
    """
    names = list(keys)
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct(*order, F.col(message).alias("__m")))))
    text = F.concat_ws(" ", F.transform(newest_first, lambda row: row["__m"]))
    pieces = in_chunks(df, names, order, chunks).groupBy(*names, CHUNK).agg(text.alias("text"))
    newest = Window.partitionBy(*names).orderBy(F.desc(CHUNK))
    return pieces.select(*names, (F.row_number().over(newest) - 1).alias("piece"), "text")


def merge_append(df: DataFrame, keys: Sequence[str], message: str, order: Sequence[str], out: str = "message", chunks: int | None = None) -> DataFrame:
    """Messages of a key joined by blanks, newest first.

    The merged text is by definition as long as the key's messages and has to fit a Spark string; ``append_pieces`` is the form
    without that bound. Messages are sorted and joined chunk by chunk; only the joined pieces meet.
    """
    pieces = append_pieces(df, keys, message, order, chunks)
    joined = F.array_sort(F.collect_list(F.struct("piece", "text")))
    return pieces.groupBy(*keys).agg(F.concat_ws(" ", F.transform(joined, lambda piece: piece["text"])).alias(out))


def merge_overlay(df: DataFrame, keys: Sequence[str], details: str, order: Sequence[str], out: str = "details") -> DataFrame:
    """Details maps of a key laid over each other in order, later entries winning.

    Each (key, member) keeps its newest value before anything is collected, so a group only ever holds one entry per member.
    """
    entries = df.select(*keys, *[F.col(name) for name in order if name not in keys], F.explode(details).alias("__member", "__value"))
    newest = entries.groupBy(*keys, "__member").agg(F.max_by("__value", F.struct(*order)).alias("__value"))
    pairs = F.array_sort(F.collect_list(F.struct("__member", "__value")))
    return newest.groupBy(*keys).agg(F.map_from_entries(pairs).alias(out))


# running merges -------------------------------------------------------------------------------------------------------


def running_merge(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Merged state at every arrival.

    ``merge_count``; and with ``value``: ``merge_sum``, ``pair_min``/``pair_max`` (of the last non-null previous value and the
    current one, which is what the keyed merge computes) and ``running_min``/``running_max`` (true running extremes).
    """
    source = df if value is None else df.withColumn("__value", value.cast("double"))
    specs = {"merge_count": Running("count")}
    if value is not None:
        specs |= {
            "merge_sum": Running("sum", F.coalesce(F.col("__value"), F.lit(0.0))),
            "running_min": Running("min", F.col("__value")),
            "running_max": Running("max", F.col("__value")),
            "__previous": Running("previous", F.col("__value")),
        }
    out = running(source, keys, order, specs, chunks)
    if value is None:
        return out
    pair = {
        "pair_min": F.least(F.col("__previous"), F.col("__value")),
        "pair_max": F.greatest(F.col("__previous"), F.col("__value")),
    }
    return out.withColumns(pair).drop("__previous", "__value")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, chunks: int | None = None) -> DataFrame:
    """Rows whose number within their key is divisible by ``n``."""
    return running(df, keys, order, {"__number": Running("count")}, chunks).filter(F.col("__number") % n == 0).drop("__number")


def rule_every_nth(n: int) -> Column:
    """The same as a condition on ``merge_count``."""
    return F.col("merge_count") % n == 0


def rule_outside(value: Column, low: float | None = None, high: float | None = None) -> Column:
    return outside_threshold(value, low, high)


def emit_any(merged: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Merged rows at least one rule lets through; no rules let everything through. Suppressed rows were merged before."""
    if not rules:
        return merged
    return merged.filter(reduce(lambda a, b: a | b, [F.coalesce(rule, F.lit(False)) for rule in rules]))


def formatted(df: DataFrame, column: str, fn: Callable[..., pd.Series], dtype: str, inputs: Sequence[str]) -> DataFrame:
    """Emitted merged rows with ``column`` made by a user function over pandas series of the input columns."""
    return df.withColumn(column, F.pandas_udf(fn, dtype)(*inputs))


# merges whose emitted row goes back into the state ---------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """Emission rules, any of which lets a merged row through; none given lets everything through."""

    every_nth: int | None = None
    every_ms: int | None = None
    below: float | None = None
    above: float | None = None

    @property
    def none(self) -> bool:
        return self.every_nth is None and self.every_ms is None and self.below is None and self.above is None

    def passes(self, number: int, at: int, mark: int | None, value: float | None) -> bool:
        filled = 0.0 if value is None else value
        return (
            self.none
            or (self.every_nth is not None and number % self.every_nth == 0)
            or (self.every_ms is not None and (mark is None or at - mark > self.every_ms))
            or (self.below is not None and filled < self.below)
            or (self.above is not None and filled > self.above)
        )


Formatter = Callable[[dict[str, Any]], dict[str, Any]]


def merge_rows(
    rows: pd.DataFrame, state: tuple, keys: Sequence[str], at: str, tie: str, value: str, rules: Rules, formatter: Formatter | None
) -> tuple[list[dict[str, Any]], tuple]:
    """Emitted merged rows of some rows of one key, in order, and the state (count, sum, last value, last emission) behind them.

    ``formatter`` sees an emitted merged row as a dict; what it returns is emitted and, for the merged members, becomes the state.
    """
    count, total, last, mark = state
    emitted = []
    names = {name: rows[name].iloc[0] for name in keys}
    for moment, row_id, current in zip(rows[at], rows[tie], rows[value]):
        current = None if pd.isna(current) else float(current)
        count += 1
        total += current or 0.0
        known = [each for each in (last, current) if each is not None]
        last = current if current is not None else last
        if rules.passes(count, int(moment), mark, current):
            mark = int(moment)
            merged = {"merge_count": count, "merge_sum": total, "pair_min": min(known) if known else None, "pair_max": max(known) if known else None}
            row = {**names, tie: int(row_id), at: int(moment), **merged}
            if formatter is not None:
                row = formatter(row)
                count, total = row["merge_count"], row["merge_sum"]
            emitted.append(row)
    return emitted, (count, total, last, mark)


def merged_with_feedback(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    value: str,
    rules: Rules,
    formatter: Formatter | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Merged rows that pass the rules, where what ``formatter`` returns goes on as the key's state: ``running_merge_stream`` on a table.

    ``at`` is a time in milliseconds, ``tie`` a long that orders rows of one time; rows without a time are left out. What a row gives
    depends on all emitted before it, so no summary of a chunk exists: a chunk of a key starts from the state its chunk before left.
    All keys go on together, one round per chunk: the first round takes the first chunk of every key, which for most is the only one,
    each later round the next chunk of the keys that reach it, fewer than there are chunks. A round reads and writes only its own rows,
    and hands on one small row per key. A chunk goes through Python in Arrow batches, so memory does not grow with it, and the rounds are
    as many as the longest key has chunks.
    """
    names, order = list(keys), [at, tie]
    spark = df.sparkSession
    slim = df.select(*names, F.col(at).cast("long").alias(at), F.col(tie).cast("long").alias(tie), F.col(value).cast("double").alias(value)).filter(F.col(at).isNotNull())
    cut = in_chunks(slim, names, order, chunks)
    spans = cut.filter(CUT).groupBy(*names).agg(F.min(CHUNK).alias("__lo"), F.max(CHUNK).alias("__hi")).filter("__lo < __hi")
    spans = written(spans, "spans")
    rounds = (spans.agg(F.max(F.col("__hi") - F.col("__lo"))).first()[0] or 0) + 1
    nth = F.coalesce(F.col(CHUNK) - F.col("__lo"), F.lit(0))
    placed = null_safe_join(cut, spans, names, "left").withColumns({"__nth": nth, "__more": F.coalesce(F.col(CHUNK) < F.col("__hi"), F.lit(False))}).drop("__lo", "__hi", CUT)
    if rounds > 1:
        folder = f"{ensure_checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
        placed.write.partitionBy("__nth").parquet(folder)
        placed = spark.read.schema(placed.schema).parquet(folder)
    kinds = {field.name: field.dataType.simpleString() for field in cut.schema.fields}
    members = "merge_count bigint, merge_sum double, pair_min double, pair_max double"
    head = ", ".join(f"`{name}` {kinds[name]}" for name in [*names, tie, at])
    state = ["__count", "__sum", "__last", "__mark"]
    schema = f"{head}, {members}, __count bigint, __sum double, __last double, __mark bigint, __kind string"
    columns = [*names, tie, at, "merge_count", "merge_sum", "pair_min", "pair_max", *state, "__kind"]

    def table(out: list[dict[str, Any]]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=columns)
        whole = {name: "Int64" for name in (tie, at, "merge_count", "__count", "__mark")}
        return made.astype(whole | {name: "float64" for name in ("merge_sum", "pair_min", "pair_max", "__sum", "__last")})

    def step(pieces: Iterator[list[tuple[bool, pd.DataFrame]]]) -> Iterator[pd.DataFrame]:
        end: tuple = ()
        left: dict[str, Any] | None = None  # the key whose state is to be handed on, if any
        for parts in pieces:
            out = []
            for goes_on, part in parts:
                if not goes_on:
                    out += [{**left, **dict(zip(state, end)), "__kind": "state"}] if left else []
                    count, total, last, mark = (None if pd.isna(v) else v for v in part[state].iloc[0])
                    end = (int(count or 0), float(total or 0.0), last, None if mark is None else int(mark))
                    left = {name: part[name].iloc[0] for name in names} if part["__more"].iloc[0] else None
                emitted, end = merge_rows(part, end, names, at, tie, value, rules, formatter)
                out += [{**row, "__kind": "row"} for row in emitted]
            yield table(out)
        if left:
            yield table([{**left, **dict(zip(state, end)), "__kind": "state"}])

    target = f"{ensure_checkpoint_dir(spark)}/feedback-{uuid.uuid4().hex}"
    empty = {"__count": F.lit(None).cast("bigint"), "__sum": F.lit(None).cast("double"), "__last": F.lit(None).cast("double"), "__mark": F.lit(None).cast("bigint")}
    for number in range(rounds):
        rows = placed.filter(F.col("__nth") == number).drop("__nth", CHUNK)
        if number:
            before = spark.read.parquet(f"{target}/round={number - 1}").filter("__kind = 'state'").select(*names, *state)
            rows = null_safe_join(rows, before, names, "left")
        else:
            rows = rows.withColumns(empty)
        sorted_pieces(rows, names, order, step, schema).write.parquet(f"{target}/round={number}")
    return spark.read.parquet(target).filter("__kind = 'row'").select(*names, tie, at, "merge_count", "merge_sum", "pair_min", "pair_max")


# throttle: emit when more than T ms passed since the last emitted row --------------------------------------------------


def _next_rows(at: np.ndarray, forced: np.ndarray, period: int) -> np.ndarray:
    """For each row as the last emitted one, the index of the next emitted row (``len(at)`` when none follows here)."""
    count = len(at)
    by_time = np.searchsorted(at, at + period, side="right")
    marks = np.where(forced, np.arange(count), count)
    following = np.minimum.accumulate(marks[::-1])[::-1]
    return np.minimum(by_time, np.append(following[1:], count))


def _exit_map(at: np.ndarray, forced: np.ndarray, period: int) -> tuple[list[int], list[int]]:
    """How a chunk maps the mark it inherits to the mark it leaves: ``exits[k]`` with k = thresholds at or below mark + period.

    Emission chains from neighbouring entry rows soon run into each other and then end at the same row, so few pieces remain.
    One exit fewer than pieces means that in the last piece nothing is emitted and the mark passes through.
    """
    count = len(at)
    following = _next_rows(at, forced, period).tolist()
    last = list(range(count))
    for index in range(count - 1, -1, -1):
        if following[index] < count:
            last[index] = last[following[index]]
    hits = np.flatnonzero(forced)
    entries = int(hits[0]) + 1 if len(hits) else count
    starts = [0] + [index for index in range(1, entries) if last[index] != last[index - 1]]
    thresholds = [int(at[index - 1]) for index in starts[1:]]
    if not len(hits):
        thresholds.append(int(at[count - 1]))
    return thresholds, [int(at[last[index]]) for index in starts]


def _leave(thresholds: Sequence[int], exits: Sequence[int], mark: int | None, period: int) -> int | None:
    piece = 0 if mark is None else int(np.searchsorted(np.asarray(thresholds, dtype=np.int64), mark + period, side="right"))
    return int(exits[piece]) if piece < len(exits) else mark


def _arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return part["__ms"].to_numpy(np.int64), part["__forced"].to_numpy(bool)


def _emitted(at: np.ndarray, forced: np.ndarray, starts: Sequence[int], marks: Sequence[int | None], period: int) -> list[int]:
    """Indexes of the rows emitted in groups of rows that begin at ``starts`` and inherit ``marks``, jumping from each emitted row to the next."""
    times, hits = memoryview(np.ascontiguousarray(at)), memoryview(np.append(np.flatnonzero(forced), len(at)).astype(np.int64))
    kept, hit = [], 0  # the first forced row that is not behind
    for start, end, mark in zip(starts, [*starts[1:], len(at)], marks):
        while hits[hit] < start:
            hit += 1
        index = min(start if mark is None else bisect_right(times, mark + period, start, end), hits[hit])
        while index < end:
            kept.append(index)
            if hits[hit] <= index < len(at):
                hit = bisect_right(hits, index, hit)
            index = min(bisect_right(times, times[index] + period, index + 1, end), hits[hit])
    return kept


def throttle(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], period_ms: int, forced: Column | None = None, chunks: int | None = None
) -> DataFrame:
    """Rows emitted under "only when more than ``period_ms`` passed since the last emitted row", per key.

    ``order`` starts with the timestamp column and is unique within a key. ``forced`` marks rows another rule emits anyway; they
    move the mark too. A row without a time is never emitted and moves nothing. Each emission depends on the one before, so no window
    expresses it: keys, order and flag go to Python in Arrow batches, and whole rows come back by a semi join. Keys lie in chunks of
    consecutive rows; for keys cut into several, each chunk reports how it maps an inherited mark to the one it leaves, those small
    maps are walked in order, and every chunk then replays with the mark it really inherits.
    """
    names = list(keys)
    order = [name for name in order if name not in names]
    stamp = order[0]
    flag = F.coalesce(forced, F.lit(False)) if forced is not None else F.lit(False)
    slim = df.select(*names, millis(F.col(stamp)).alias("__ms"), *order, flag.alias("__forced")).filter(F.col("__ms").isNotNull())
    rows = in_chunks(slim, names, order, chunks)
    group = [*names, CHUNK]
    types = {field.name: field.dataType.simpleString() for field in rows.schema.fields}

    def ddl(*columns: str) -> str:
        return ", ".join(f"`{name}` {types[name]}" for name in columns)

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        starts = group_starts(frame, group)
        marks = [None if pd.isna(mark) else int(mark) for mark in frame["__mark"].iloc[starts]]
        return frame.iloc[_emitted(*_arrays(frame), starts, marks, period_ms)][[*names, *order]]

    def summarize(frame: pd.DataFrame) -> pd.DataFrame:
        firsts, thresholds, exits = [], [], []
        for part in each_group(frame, group):
            firsts.append(part.iloc[:1][group])
            bounds, ends = _exit_map(*_arrays(part), period_ms)
            thresholds.append(bounds)
            exits.append(ends)
        return pd.concat(firsts, ignore_index=True).assign(__thresholds=thresholds, __exits=exits)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        marks: list[int | None] = []
        for part in each_group(frame, names):
            mark = None
            for thresholds, exits in zip(part["__thresholds"], part["__exits"]):
                marks.append(mark)
                mark = _leave(thresholds, exits, mark, period_ms)
        return frame[group].assign(__mark=pd.array(marks, dtype="Int64"))

    wide = rows.filter(CUT).drop(CUT)
    maps = sorted_groups(wide, group, order, summarize, f"{ddl(*group)}, __thresholds array<bigint>, __exits array<bigint>")
    # a row per chunk of the keys that are cut: bounded by the sample the splitters come from
    marks = F.broadcast(sorted_groups(maps, names, [CHUNK], walk, f"{ddl(*group)}, __mark bigint"))
    emitted = sorted_groups(null_safe_join(rows.drop(CUT), marks, group, "left"), group, order, replay, ddl(*names, *order))
    return null_safe_join(df, emitted, [*names, *order], "left_semi")
