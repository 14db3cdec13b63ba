"""User functions: per batch, per group, with dynamic groups, and over several inputs.

Three ways to run a function per group:

* ``reduce_groups``: the function is a ``GroupReducer`` (reduce rows, merge reduced rows, finish). Rows are reduced where they
  are read, so a hot key sends one small row per task through the shuffle. Frames hold many groups, so pandas works on columns.
* ``sorted_groups``: frames of whole groups, many at a time, for groups known to be small (or cut into chunks before).
* ``grouped_apply``: any function over one group at a time, streamed through it in Arrow batches and never built in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from docsieve.session import written

Frames = Iterator[pd.DataFrame]


class BatchModule:
    """A user module: subclass and override. One instance runs per task; ``group`` is called per grouping key."""

    def setup(self, options: Mapping[str, Any]) -> None:
        """Called once before the first batch."""

    def batch(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Rows to emit for a batch: any number, including none."""
        return rows

    def complete(self) -> pd.DataFrame | None:
        """Called once after the last batch; may emit more rows."""
        return None


def batch_apply(df: DataFrame, module: type[BatchModule], schema: T.StructType | str, options: Mapping[str, Any] | None = None) -> DataFrame:
    """Ungrouped module: set up, every batch, complete, per task."""
    settings = dict(options or {})

    def run(frames: Frames) -> Frames:
        instance = module()
        instance.setup(settings)
        for frame in frames:
            out = instance.batch(frame)
            if out is not None and len(out):
                yield out
        tail = instance.complete()
        if tail is not None and len(tail):
            yield tail

    return df.mapInPandas(run, schema)


ERROR_ROW, ERROR_TEXT = "__row", "__error"


def isolate(fn: Callable[[pd.DataFrame], pd.DataFrame | None], rows: pd.DataFrame) -> tuple[list[pd.DataFrame], list[tuple[int, str]]]:
    """Outputs of ``fn`` over ``rows``, halved and tried again where it raises, down to single rows; and (place, message) of rows on
    which it raises alone. A frame of n rows of which k fail takes about 2 k log n more calls."""
    outputs, failed, waiting = [], [], [(0, len(rows))]
    while waiting:
        start, end = waiting.pop()
        try:
            out = fn(rows.iloc[start:end].reset_index(drop=True))
        except Exception as error:  # whatever a user's function raises becomes a row of the error channel
            if end - start == 1:
                failed.append((start, f"{type(error).__name__}: {error}"))
            else:
                middle = (start + end) // 2
                waiting += [(middle, end), (start, middle)]
            continue
        if out is not None and len(out):
            outputs.append(out)
    return outputs, failed


def batch_isolated(
    df: DataFrame, module: type[BatchModule], schema: T.StructType | str, options: Mapping[str, Any] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``batch_apply`` whose failing rows do not end the job: (output, errors).

    A batch on which the module raises is halved until single rows are left; these become rows (``__error``, ``__row``: the input row as
    JSON) and the others are emitted. The module sees rows of a failing batch again, in smaller batches, so ``batch`` must not keep what
    it has seen before it is sure to return. Raising in ``setup`` or ``complete`` ends the job, since no row is to blame. The module runs
    once: its output is a table in the shared folder, which both results read.
    """
    settings = dict(options or {})
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    names = [field.name for field in fields]
    whole = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(ERROR_TEXT, T.StringType()), T.StructField(ERROR_ROW, T.StringType())])

    def run(frames: Frames) -> Frames:
        instance = module()
        instance.setup(settings)
        for frame in frames:
            outputs, failed = isolate(instance.batch, frame)
            for out in outputs:
                yield out[names].assign(**{ERROR_TEXT: None, ERROR_ROW: None})
            if failed:
                rows = [frame.iloc[[place]].to_json(orient="records", lines=True, date_format="iso", date_unit="us").strip() for place, _ in failed]
                yield pd.DataFrame({name: None for name in names} | {ERROR_TEXT: [text for _, text in failed], ERROR_ROW: rows})
        tail = instance.complete()
        if tail is not None and len(tail):
            yield tail[names].assign(**{ERROR_TEXT: None, ERROR_ROW: None})

    both = written(df.mapInPandas(run, whole), "isolated")
    good = both.filter(F.col(ERROR_TEXT).isNull()).select(*[F.col(f"`{name}`") for name in names])
    return good, both.filter(F.col(ERROR_TEXT).isNotNull()).select(ERROR_TEXT, ERROR_ROW)


def _stream(fn: Callable) -> Callable:
    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(key, frames)

    return run


def grouped_apply(
    df: DataFrame, keys: Sequence[str], fn: Callable[[tuple, Frames], Frames], schema: T.StructType | str
) -> DataFrame:
    """``fn(key, frames)`` yields output frames for one group; the order of rows inside a group is not defined.

    A group runs in one task, whatever its size: where the function can be split, use ``reduce_groups``.
    """
    return df.groupBy(*keys).applyInPandas(_stream(fn), schema)


class GroupReducer:
    """A group function in three parts, each from pandas frame to pandas frame over many groups at once.

    ``indexed`` promises that each row ``finish`` returns has the index of the reduced row it comes from, as column arithmetic keeps it;
    where a row's group has to be known, ``finish`` is else called group by group.
    """

    indexed = False

    def reduce(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Some rows of some groups to reduced rows (key columns included)."""
        raise NotImplementedError

    def merge(self, reduced: pd.DataFrame) -> pd.DataFrame:
        """Reduced rows to fewer reduced rows; merging in any order gives the same."""
        raise NotImplementedError

    def finish(self, reduced: pd.DataFrame) -> pd.DataFrame:
        """All reduced rows of some groups, one per key, to the output: any number of rows."""
        return reduced


_MERGE_AT = 100_000


def reduce_rows(df: DataFrame, reducer: type[GroupReducer], reduced_schema: T.StructType | str) -> DataFrame:
    """First part of a ``GroupReducer``, where the rows are: a few reduced rows per key and task, nothing is shuffled."""

    def reduce(frames: Frames) -> Frames:
        instance, held, count = reducer(), [], 0
        for frame in frames:
            part = instance.reduce(frame)
            held.append(part)
            count += len(part)
            if count > _MERGE_AT:
                merged = instance.merge(pd.concat(held, ignore_index=True))
                if len(merged) > count // 2:
                    # mostly distinct keys: holding on to them would not reduce anything
                    yield merged
                    merged = merged.iloc[:0]
                held, count = [merged], len(merged)
        if count:
            yield instance.merge(pd.concat(held, ignore_index=True))

    return df.mapInPandas(reduce, reduced_schema)


def finish_groups(
    reduced: DataFrame, keys: Sequence[str], reducer: type[GroupReducer], schema: T.StructType | str, tagged: bool = False
) -> DataFrame:
    """Second part: one shuffle of reduced rows by key, merge and finish.

    ``tagged`` adds the group of each row, as ``__g_<key>``, and the place of the row among those of its group, ``__n``.
    """
    names = list(keys)

    def pieces(instance: GroupReducer, merged: pd.DataFrame) -> Iterator[pd.DataFrame]:
        merged = merged.reset_index(drop=True)
        parts = [merged] if instance.indexed else [merged.iloc[[row]] for row in range(len(merged))]
        for part in parts:
            out = instance.finish(part if instance.indexed else part.reset_index(drop=True))
            if out is None or not len(out):
                continue
            at = out.index.to_numpy() if instance.indexed else np.full(len(out), part.index[0])
            if instance.indexed and not np.isin(at, merged.index).all():
                raise ValueError("finish returned rows whose index is of no reduced row")
            groups = merged.loc[at, names].rename(columns=lambda name: f"__g_{name}").reset_index(drop=True)
            yield pd.concat([out.reset_index(drop=True), groups], axis=1).assign(__n=pd.Series(at).groupby(at).cumcount().to_numpy())

    def finish(frames: Frames) -> Frames:
        instance = reducer()
        for frame in _whole_groups(frames, names, instance.merge):
            merged = instance.merge(frame)
            if tagged:
                yield from pieces(instance, merged)
            else:
                yield instance.finish(merged)

    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if tagged:
        kinds = {field.name: field.dataType for field in reduced.schema.fields}
        extra = [T.StructField(f"__g_{name}", kinds[name]) for name in names] + [T.StructField("__n", T.LongType())]
        out = T.StructType([*out.fields, *extra])
    return reduced.repartition(*names).sortWithinPartitions(*names).mapInPandas(finish, out)


def reduce_groups(
    df: DataFrame, keys: Sequence[str], reducer: type[GroupReducer], reduced_schema: T.StructType | str, schema: T.StructType | str
) -> DataFrame:
    """Run a ``GroupReducer``: reduce where the rows are, one shuffle of reduced rows, merge and finish."""
    return finish_groups(reduce_rows(df, reducer, reduced_schema), keys, reducer, schema)


def sorted_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """``fn`` gets frames of whole groups, many at a time, sorted by key and then by ``order``. For groups of bounded size."""
    names = list(keys)

    def run(frames: Frames) -> Frames:
        for frame in _whole_groups(frames, names):
            yield fn(frame)

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(run, schema)


def sorted_pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[Iterator[list[tuple[bool, pd.DataFrame]]]], Frames], schema: T.StructType | str
) -> DataFrame:
    """``fn`` gets the sorted rows of a task as lists of (goes on, rows), a list per Arrow batch: a group of any size comes in pieces, and
    ``goes on`` says that the piece belongs to the group of the piece before. Memory is bounded by a batch and what ``fn`` keeps."""
    names = list(keys)

    def pieces(frames: Frames) -> Iterator[list[tuple[bool, pd.DataFrame]]]:
        last: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            goes_on = last is not None and len(group_starts(pd.concat([last, frame.iloc[:1][names]], ignore_index=True), names)) == 1
            yield [(goes_on and not number, part) for number, part in enumerate(each_group(frame, names))]
            last = frame.iloc[-1:][names].copy()

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(lambda frames: fn(pieces(frames)), schema)


def each_group(frame: pd.DataFrame, keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Groups of a frame sorted by key."""
    starts = group_starts(frame, keys)
    for start, end in zip(starts, [*starts[1:], len(frame)]):
        yield frame.iloc[start:end]


def group_starts(frame: pd.DataFrame, names: Sequence[str]) -> list[int]:
    """Row numbers at which a new key starts."""
    new = np.zeros(len(frame), dtype=bool)
    new[:1] = True
    for name in names:
        column = frame[name]
        before = column.shift()
        new |= ~((column == before) | (column.isna() & before.isna())).fillna(False).to_numpy(bool)
    new[:1] = True
    return [int(index) for index in np.flatnonzero(new)]


def _whole_groups(frames: Frames, names: list[str], shrink: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> Frames:
    """Frames re-cut at key boundaries: the last group of a frame waits for the frames that may continue it."""
    waiting: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        joined = pd.concat([*waiting[-1:], frame.iloc[:1]], ignore_index=True) if waiting else frame
        if waiting and len(group_starts(joined.iloc[-2:], names)) == 2:
            yield pd.concat(waiting, ignore_index=True)
            waiting = []
        last = group_starts(frame, names)[-1]
        if last:
            yield pd.concat([*waiting, frame.iloc[:last]], ignore_index=True)
            waiting = []
        waiting.append(frame.iloc[last:])
        if shrink is not None and sum(map(len, waiting)) > _MERGE_AT:
            waiting = [shrink(pd.concat(waiting, ignore_index=True))]
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def dynamic_groups(df: DataFrame, assign: Column) -> DataFrame:
    """Dynamic grouping: the step before names the group of each row in ``__group``; rows without one are dropped."""
    return df.withColumn("__group", assign).filter(F.col("__group").isNotNull())


def tag_inputs(inputs: Mapping[str, DataFrame], injected: bool = False) -> DataFrame:
    """All inputs as one DataFrame; ``__input`` names the input of each row, ``__injected`` marks system-made rows.

    Any of the group functions run on the result is a cogroup of the inputs.
    """
    out = None
    for name, df in inputs.items():
        tagged = df.withColumns({"__input": F.lit(name), "__injected": F.lit(injected)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out
