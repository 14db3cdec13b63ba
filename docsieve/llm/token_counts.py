"""Token counts of whole texts; huge texts by overlapping chunks that are spliced where both encodings agree for certain."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import slices, worker_cache

#: A text of more characters is huge; characters a chunk advances by; first overlap; chunks encoded at once; cached runs a worker, held twice at most.
HUGE = 32_768
STEP = 16_384
OVERLAP = 256
BATCH = 8
CACHE = 250_000
#: White space with the run behind it. No word of the byte-level pattern reaches from other text into white space, and how white space
#: is cut depends on the run and the one character behind it, so a text's tokens are those of its runs, one after the other.
_RUN = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space, the tokenizer's pattern does not.
_ODD = re.compile(r"[\x1c-\x1f]")


class Counter:
    """Counts tokens as the tokenizer file's library does, special strings included, nothing added."""

    def __init__(self, path: str, huge: int = HUGE, step: int = STEP, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # an overlap holds any special string whole, so a cut one is seen whole by a neighbour
        longest = max((len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), default=0)
        self.huge, self.step, self.overlap = huge, step, max(overlap, 2 * longest)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}  # what was known before ``known`` was full; what is met again moves over

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.huge:
            return self.spliced(text)
        if _ODD.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        runs, known, older = _RUN.findall(text), self.known, self.older
        missing = {run for run in runs if run not in known}
        known.update((run, older[run]) for run in missing if run in older)
        new = [run for run in missing if run not in older]
        if new:
            for run, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                known[run] = len(found)
        return sum(map(known.__getitem__, runs))

    def _encoded(self, text: str, ranges: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each chunk: the offsets in the text at which words start, the chunk's tokens before each, and its tokens."""
        out = []
        for (begin, _), found in zip(ranges, self.tokenizer.encode_batch([text[a:b] for a, b in ranges], add_special_tokens=False)):
            words = np.array(found.word_ids, np.int64)
            first = np.flatnonzero(np.diff(words, prepend=-1) != 0)
            starts = np.array([o[0] for o in found.offsets], np.int64)
            out.append((starts[first] + begin, first, len(words)))
        return out

    def spliced(self, text: str) -> int:
        """Count by chunks.

        Chunk i starts at i * step and ends an overlap behind the start of chunk i + 1. Splicing is allowed at an offset at which a word
        starts in both: cutting into words goes from left to right and needs only the text from where the last word ended, so up to
        there the left chunk is right if its own start was, and from there the right chunk is, whatever it made of its first
        characters. Where no such offset lies inside the overlap, the overlap doubles, in the end up to the text's end.
        """
        size = len(text)
        begins = range(0, size, self.step)
        overlap = [self.overlap] * len(begins)
        ready: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

        def stop(i: int) -> int:
            return min(size, begins[i] + self.step + overlap[i])

        def encode(*chunks: int) -> None:
            ready.update(zip(chunks, self._encoded(text, [(begins[j], stop(j)) for j in chunks])))

        # chunk at hand; where words are known to be right in it; its tokens before that; tokens of all before
        i = origin = before = total = 0
        encode(0)
        while stop(i) < size:
            if i + 1 not in ready:
                encode(*range(i + 1, min(i + 1 + BATCH, len(begins))))
            left, right = ready[i], ready[i + 1]
            common = np.intersect1d(left[0], right[0])
            common = common[common >= max(origin, begins[i + 1])]
            if len(common):
                total += int(left[1][np.searchsorted(left[0], common[0])]) - before
                del ready[i]
                i, origin, before = i + 1, int(common[0]), int(right[1][np.searchsorted(right[0], common[0])])
            else:
                overlap[i] *= 2
                again = [i]
                if stop(i + 1) < min(size, stop(i) + self.overlap):  # the right chunk reaches further than the left one
                    overlap[i + 1] = stop(i) + self.overlap - begins[i + 1] - self.step
                    again.append(i + 1)
                encode(*again)
        return total + ready[i][2] - before


def _counter(path: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = worker_cache(("count", path), lambda: Counter(path))
        for batch in slices(batches):
            yield pa.array([counter.count(text) for text in batch.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long").asNondeterministic()


def with_token_counts(documents: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``documents`` with the number of tokens of each whole text under the byte-level tokenizer file at ``path``.

    Null and empty texts have 0. Texts above ``HUGE`` characters are counted by spliced chunks, so that what the library holds at once
    is some chunks, not the encoding of the text. Nothing is truncated.
    """
    return documents.withColumn(into, _counter(path)(F.col(text)))
