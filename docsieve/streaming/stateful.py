"""Running merges and emission rules on a live stream, with the merged state of each key kept by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docsieve.operators.merge import Rules, merge_rows

STATE = T.StructType(
    [
        T.StructField("count", T.LongType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("last", T.DoubleType()),
        T.StructField("mark", T.LongType()),
    ]
)


def merge_processor(
    rules: Rules, key: str, at: str, value: str, tie: str, formatter: Callable[[dict[str, Any]], dict[str, Any]] | None = None
) -> type[StatefulProcessor]:
    """Processor class keeping count, sum, last value and last emission time of one key.

    ``formatter`` sees an emitted merged row as a dict; what it returns is emitted and, for the merged members, becomes the state.
    Rows of a micro-batch are taken in ``(at, tie)`` order; state per key is four numbers whatever the key's volume.
    """

    def _merged(batch: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        """Merged rows that pass rules without memory, as arrays, and the state behind the batch."""
        count, total, last, mark = state
        values = batch[value].to_numpy(np.float64, na_value=np.nan)
        filled = np.nan_to_num(values, nan=0.0)
        known = pd.Series(np.concatenate([[np.nan if last is None else last], values])).ffill().to_numpy()
        numbers, sums = count + np.arange(1, len(batch) + 1), total + np.cumsum(filled)
        keep = np.full(len(batch), rules.none)
        if rules.every_nth is not None:
            keep |= numbers % rules.every_nth == 0
        if rules.below is not None:
            keep |= filled < rules.below
        if rules.above is not None:
            keep |= filled > rules.above
        merged = batch[[key, tie, at]].assign(
            merge_count=numbers, merge_sum=sums, pair_min=np.fmin(known[:-1], values), pair_max=np.fmax(known[:-1], values)
        )[keep]
        if keep.any():
            mark = int(merged[at].iloc[-1])
        return merged, (int(numbers[-1]), float(sums[-1]), None if np.isnan(known[-1]) else float(known[-1]), mark)

    class KeyedMerge(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._state = handle.getValueState("merged", STATE)

        def handleInputRows(self, keys, rows, timerValues) -> Iterator[pd.DataFrame]:
            stored = self._state.get() if self._state.exists() else None
            count, total, last, mark = stored if stored is not None else (0, 0.0, None, None)
            batch = pd.concat(list(rows), ignore_index=True).sort_values([at, tie], kind="stable")
            if rules.every_ms is None and formatter is None:
                merged, state = _merged(batch, (count, total, last, mark))
                self._state.update(state)
                if len(merged):
                    yield merged
                return
            # what is emitted here depends on what was emitted before, row by row
            emitted, state = merge_rows(batch, (count, total, last, mark), (key,), at, tie, value, rules, formatter)
            self._state.update(state)
            if emitted:
                yield pd.DataFrame(emitted)

        def close(self) -> None:
            pass

    return KeyedMerge


def running_merge_stream(
    stream: DataFrame,
    key: str,
    at: str,
    value: str,
    tie: str,
    rules: Rules = Rules(),
    formatter: Callable[[dict[str, Any]], dict[str, Any]] | None = None,
) -> DataFrame:
    """Merged rows that pass the rules, from a stream with a millisecond column ``at``. Needs the RocksDB state store.

    A key's micro-batch rows meet in one task, so bound the micro-batch (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). The
    state has no watermark: it is four numbers per key and keys are the merge keys in use.
    """
    key_type = stream.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField(tie, T.LongType()),
            T.StructField(at, T.LongType()),
            T.StructField("merge_count", T.LongType()),
            T.StructField("merge_sum", T.DoubleType()),
            T.StructField("pair_min", T.DoubleType()),
            T.StructField("pair_max", T.DoubleType()),
        ]
    )
    processor = merge_processor(rules, key, at, value, tie, formatter)
    return (
        stream.select(key, tie, at, value)
        .groupBy(key)
        .transformWithStateInPandas(statefulProcessor=processor(), outputStructType=schema, outputMode="Append", timeMode="None")
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
