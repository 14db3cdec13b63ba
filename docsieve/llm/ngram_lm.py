"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark, kept as sorted arrays of hashes that workers map into memory.

Files below one shared folder, cut into shards that hold a bounded share of the counts each:

* ``words-<s>``: hashes of the different words in order, and their counts. A word's number is its place.
* ``pairs-<s>``: pairs (number of the word before, number of the word) in order, and their counts.
* ``states-<s>``: beside ``words``: pairs a word begins, how many of them occur once, twice, more often, and how many it ends.

A lookup maps a shard and searches it, so a worker holds what it reads, and pages come and go as memory allows. Shards in a store that
cannot be mapped are read whole, one at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import LOWER_BYTES, saved, shared_folder, slices, worker_cache

#: Tokens per shard at most, roughly; tokens a worker adds up or scores at once; shards a worker keeps mapped.
SHARD = 4_000_000
BLOCK = 1_500_000
MAPPED = 64
#: A word that makes up this part of a shard or more is spread over shards by the word behind it.
SHARE = 8
#: More different words than numbers of 31 bits are refused.
WORDS = (1 << 31) - 2
_STATES = ("begins", "once", "twice", "more", "ends")


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


#: No word has white space in it, so this stands for the end of a text. The begin is no token; its number is one past the last word's.
END = b"\n"


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens per text): words without ASCII white space, A-Z lower-cased, then one end."""
    sizes, out = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []
        words.append(END)
        sizes.append(len(words))
        out.extend(words)
    return np.fromiter(map(_hash, out), np.uint64, len(out)), np.array(sizes, np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


class _Files:
    """Shards below a folder. They are written under another name and moved, and hold the same whatever attempt of a task wrote them."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.local = isinstance(self.fs, fs.LocalFileSystem)
        self.get = lru_cache(MAPPED if self.local else 1)(self._get)

    def make(self) -> None:
        self.fs.create_dir(self.folder, recursive=True)

    def put(self, name: str, *columns: np.ndarray) -> None:
        from pyarrow import fs

        part, whole = f"{self.folder}/{name}.{uuid.uuid4().hex}", f"{self.folder}/{name}"
        with self.fs.open_output_stream(part) as out:
            for column in columns:
                out.write(np.ascontiguousarray(column).data if len(column) else b"")
        if not self.local and self.fs.get_file_info(whole).type != fs.FileType.NotFound:
            self.fs.delete_file(part)
        else:
            self.fs.move(part, whole)

    def _get(self, name: str) -> np.ndarray:
        from pyarrow import fs

        path = f"{self.folder}/{name}"
        info = self.fs.get_file_info(path)
        if info.type == fs.FileType.NotFound or not info.size:
            return np.empty(0, np.uint8)
        if self.local:
            return np.memmap(path, np.uint8, "r")
        with self.fs.open_input_file(path) as file:
            return np.frombuffer(file.read(), np.uint8)

    def columns(self, name: str, *kinds: str) -> list[np.ndarray]:
        raw = self.get(name)
        rows = len(raw) // sum(np.dtype(kind).itemsize for kind in kinds)
        out, at = [], 0
        for kind in kinds:
            size = rows * np.dtype(kind).itemsize
            out.append(raw[at : at + size].view(kind))
            at += size
        return out


def _files(folder: str) -> _Files:
    return worker_cache(("shards", folder), lambda: _Files(folder), keep=8)


@dataclass(frozen=True)
class _Words:
    """Numbers and counts of words. ``starts``: number of the first word of each shard, and how many words there are."""

    folder: str
    starts: tuple[int, ...]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, counts) of sorted hashes; -1 and 0 for unknown ones."""
        numbers, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shards = len(self.starts) - 1
        for s, (a, b) in _spans(_shard_of(hashes, shards), shards):
            keys, n = _files(self.folder).columns(f"words-{s}", "<u8", "<u8")
            if len(keys):
                place = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                hit = keys[place] == hashes[a:b]
                numbers[a:b] = np.where(hit, place + self.starts[s], -1)
                counts[a:b] = np.where(hit, n[place], 0)
        return numbers, counts


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _spans(shard: np.ndarray, shards: int) -> Iterator[tuple[int, tuple[int, int]]]:
    """(shard, its first and one past its last place) of sorted shard numbers."""
    found, first = np.unique(shard, return_index=True)
    yield from zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(shard)]))


def _pair_shard(before: np.ndarray, word: np.ndarray, count_before: np.ndarray, shards: int, heavy: int) -> np.ndarray:
    """Shard of a pair: by the word before, and by both where that one is heavy. A word before that is the begin has count -1: heavy."""
    key = before.astype(np.uint64) << np.uint64(32)
    key = np.where((count_before >= heavy) | (count_before < 0), key | word.astype(np.uint64), key)
    return (_mixed(key) % np.uint64(shards)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    """Texts of training rows, about ``BLOCK`` tokens at a time; sizes in bytes stand for tokens."""
    held, size = [], 0
    for batch in slices(batches):
        for text in batch["text"].to_pylist():
            held.append(text)
            size += 1 + (len(text) // 5 if text else 0)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _blocks(batches):
            keys, n = np.unique(token_hashes(texts)[0], return_counts=True)
            yield _counts(_shard_of(keys, shards), keys.view(np.int64), n)

    return run


def _counts(shard: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["shard", "key", "n"])


_COUNTS = "shard int, key long, n long"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, counts) of each shard from rows sorted by shard: a task holds one shard's keys at a time."""

    def close(shard: int, keys: list[np.ndarray], counts: list[np.ndarray]):
        k, n = np.concatenate(keys).view(np.uint64), np.concatenate(counts)
        k, place = np.unique(k, return_inverse=True)
        return shard, k, np.bincount(place, weights=n, minlength=len(k)).astype(np.int64) if len(k) else n

    at, keys, counts = None, [], []
    for batch in batches:
        shard, key, n = (batch[name].to_numpy() for name in ("shard", "key", "n"))
        if not len(shard):
            continue
        for s, (a, b) in _spans(shard, 0):
            if at is not None and s != at:
                yield close(at, keys, counts)
                keys, counts = [], []
            at = s
            keys.append(key[a:b].copy())
            counts.append(n[a:b].copy())
    if at is not None:
        yield close(at, keys, counts)


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, n in _merged(batches):
            _files(folder).put(f"words-{shard}", keys, n.astype("<u8"))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "words": len(keys), "tokens": int(n.sum())}], schema=pa.schema([("shard", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64())]))

    return run


def _numbered(words: _Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of different words, their counts, place of each token among them, tokens per text)."""
    hashes, sizes = token_hashes(texts)
    different, place = np.unique(hashes, return_inverse=True)
    numbers, counts = words.find(different)
    return numbers, counts, place, sizes


def _before(values: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """Value of the token before each token; ``begin`` for the first of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.cumsum(sizes) - sizes] = begin
    return out


def _count_pairs(words: _Words, shards: int, heavy: int):
    begin = words.starts[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _blocks(batches):
            numbers, counts, place, sizes = _numbered(words, texts)
            word, count = numbers[place], counts[place]
            pair = _before(word, sizes, begin).astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
            count = _before(count, sizes, -1)
            different, first, n = np.unique(pair, return_index=True, return_counts=True)
            shard = _pair_shard(different >> np.uint64(32), different & np.uint64(0xFFFFFFFF), count[first], shards, heavy)
            yield _counts(shard, different.view(np.int64), n)

    return run


_PART = "word long, begins long, once long, twice long, more long, ends long, ones long, twos long, threes long, fours long"


def _write_pairs(folder: str):
    names = [c.split()[0] for c in _PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, n in _merged(batches):
            if n.max(initial=0) >= 1 << 32:
                raise ValueError("a word pair occurs 2^32 times or more")
            _files(folder).put(f"pairs-{shard}", keys, n.astype("<u4"))
            head, first = np.unique(keys >> np.uint64(32), return_index=True)
            sums = lambda values: np.add.reduceat(values, first) if len(first) else values
            zero = np.zeros(len(head), np.int64)
            parts = [head.astype(np.int64), sums(n), sums((n == 1).astype(np.int64)), sums((n == 2).astype(np.int64)), sums((n > 2).astype(np.int64)), *[zero] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names)
            tail, ends = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            zero = np.zeros(len(tail), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in [tail.astype(np.int64), *[zero] * 4, ends.astype(np.int64), *[zero] * 4]], names)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in [-1, 0, 0, 0, 0, 0, *[int((n == k).sum()) for k in (1, 2, 3, 4)]]], names)

    return run


def _write_states(words: _Words):
    starts = np.array(words.starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close():
            rows = np.concatenate(held)
            size = starts[at + 1] - starts[at]
            out = np.zeros((size, 5), np.int64)
            out[rows[:, 0] - starts[at]] = rows[:, 1:]
            _files(words.folder).put(f"states-{at}", *[out[:, k].astype("<u8") for k in range(5)])
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32())], ["shard"])

        for batch in batches:
            shard = batch["shard"].to_numpy()
            rows = np.stack([batch[name].to_numpy() for name in ("word", *_STATES)], axis=1)
            for s, (a, b) in _spans(shard, 0) if len(shard) else ():
                if at is not None and s != at:
                    yield close()
                    held = []
                at = s
                held.append(rows[a:b])
        if at is not None:
            yield close()

    return run


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Amounts taken from counts of 1, 2 and 3 or more. Where counts of counts give none between 0 and the count: 0.5, 1, 1.5."""
    if min(ones, twos, threes) > 0:
        y = ones / (ones + 2 * twos)
        found = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes)
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


@dataclass(frozen=True)
class Model:
    """A trained model. ``pair_cuts`` and ``word_cuts``: discounts of pairs and of words by the pairs they end; ``begin``: state of a text's begin."""

    folder: str
    starts: tuple[int, ...]
    shards: int
    heavy: int
    tokens: int
    pair_types: int
    pair_cuts: tuple[float, float, float]
    word_cuts: tuple[float, float, float]
    word_types: tuple[int, int, int]
    begin: tuple[int, int, int, int]


def trained(documents: DataFrame, text: str = "text", shard_tokens: int = SHARD) -> Model:
    """Count the word pairs of all whole texts and write the model's files below the shared folder.

    A null text is empty: it has one token, its end. Words are counted first and numbered by the order of their hashes (two words of one
    64-bit hash would be one word). Each task adds up the pairs of a block of text, a shard's task the pairs of a shard; a word that begins
    a good part of a shard's pairs is spread over shards. No rows: a model that knows no word.
    """
    rows = documents.select(F.col(f"`{text}`").alias("text"))
    size = rows.agg((F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) / 5 + F.count("*")).cast("long")).first()[0] or 0
    shards = max(1, -(-size // shard_tokens))
    folder = shared_folder(documents.sparkSession, "ngrams")
    _files(folder).make()

    counted = rows.mapInArrow(_count_words(shards), _COUNTS).repartition("shard").sortWithinPartitions("shard")
    written = saved(counted.mapInArrow(_write_words(folder), "shard int, words long, tokens long"), "word-shards").collect()  # a row a shard
    sizes = dict.fromkeys(range(shards), 0) | {r["shard"]: r["words"] for r in written}
    starts = tuple(np.concatenate([[0], np.cumsum([sizes[s] for s in range(shards)])]).astype(int).tolist())
    tokens = sum(r["tokens"] for r in written)
    if starts[-1] > WORDS:
        raise ValueError(f"{starts[-1]} different words; {WORDS} can be numbered")
    words = _Words(folder, starts)

    heavy = max(1, shard_tokens // SHARE)
    pairs = rows.mapInArrow(_count_pairs(words, shards, heavy), _COUNTS).repartition("shard").sortWithinPartitions("shard")
    parts = saved(pairs.mapInArrow(_write_pairs(folder), _PART), "pair-shards")
    states = saved(parts.groupBy("word").agg(*[F.sum(c.split()[0]).alias(c.split()[0]) for c in _PART.split(", ")[1:]]), "word-states")

    by_ends = [F.count_if((F.col("ends") == k) & (F.col("word") >= 0)).alias(f"e{k}") for k in (1, 2, 3, 4)]
    total = states.agg(F.coalesce(F.sum("ends"), F.lit(0)).alias("types"), F.count_if(F.col("ends") > 2).alias("many"), *by_ends).first()
    seen = states.where("word = -1").select("ones", "twos", "threes", "fours").first() or (0, 0, 0, 0)
    first = states.where(F.col("word") == starts[-1]).select("begins", "once", "twice", "more").first() or (0, 0, 0, 0)

    inside = states.where((F.col("word") >= 0) & (F.col("word") < starts[-1])).select("word", *_STATES)
    inside = inside.mapInArrow(_with_shard(starts), f"word long, {', '.join(f'{name} long' for name in _STATES)}, shard int")
    saved(inside.repartition("shard").sortWithinPartitions("shard").mapInArrow(_write_states(words), "shard int"), "state-shards")
    return Model(folder, starts, shards, heavy, tokens, total["types"], discounts(*seen), discounts(*[total[f"e{k}"] for k in (1, 2, 3, 4)]), (total["e1"], total["e2"], total["many"]), tuple(first))


def _with_shard(starts: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.searchsorted(np.array(starts[1:-1]), batch["word"].to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    return run


class Scorer:
    """Scores texts by a model's files."""

    def __init__(self, model: Model):
        self.model, self.words = model, _Words(model.folder, model.starts)

    def _states(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of ``states`` for sorted numbers, which are known."""
        out = np.zeros((len(numbers), 5), np.int64)
        shard = np.searchsorted(np.array(self.model.starts[1:-1]), numbers, side="right")
        for s, (a, b) in _spans(shard, 0) if len(numbers) else ():
            columns = _files(self.model.folder).columns(f"states-{s}", *["<u8"] * 5)
            at = numbers[a:b] - self.model.starts[s]
            for k, column in enumerate(columns):
                out[a:b, k] = column[at]
        return out

    def _pairs(self, pair: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Counts of different pairs."""
        order = np.lexsort((pair, shard))
        out = np.zeros(len(pair), np.int64)
        for s, (a, b) in _spans(shard[order], 0) if len(pair) else ():
            keys, n = _files(self.model.folder).columns(f"pairs-{s}", "<u8", "<u4")
            if len(keys):
                wanted = pair[order[a:b]]
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                out[order[a:b]] = np.where(keys[place] == wanted, n[place], 0)
        return out

    @staticmethod
    def _cut(count: np.ndarray, cuts: tuple[float, float, float]) -> np.ndarray:
        return np.array([0.0, *cuts])[np.minimum(count, 3)]

    def score(self, texts: list[str | None]) -> list[tuple[np.ndarray, ...]]:
        """(n_tokens, n_known, base_score, score) of each text, as arrays."""
        m = self.model
        numbers, counts, place, sizes = _numbered(self.words, texts)
        begin, vocabulary = m.starts[-1], m.starts[-1]
        base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (vocabulary + 1)))

        # words by the pairs they end, down to an even share for every known word and one for all unknown ones
        known = numbers >= 0
        state = np.zeros((len(numbers), 5), np.int64)
        order = np.flatnonzero(known)
        state[order] = self._states(numbers[order])
        if m.pair_types:
            even = sum(d * n for d, n in zip(m.word_cuts, m.word_types)) / m.pair_types
            low = (state[:, 4] - self._cut(state[:, 4], m.word_cuts)) / m.pair_types + even / (vocabulary + 1)
        else:
            low = np.full(len(numbers), 1.0 / (vocabulary + 1))

        # pairs; the place of the begin is one past the last different word
        place_before = _before(place, sizes, len(numbers))
        number = np.append(numbers, begin)
        both, back = np.unique(place_before * (len(numbers) + 1) + place, return_inverse=True)
        before, word = both // (len(numbers) + 1), both % (len(numbers) + 1)
        old = np.vstack([state[:, :4], [m.begin]])[before]
        probability = low[word]
        seen = np.flatnonzero(old[:, 0] > 0)
        pair = number[before[seen]].astype(np.uint64) << np.uint64(32) | number[word[seen]].astype(np.uint64) & np.uint64(0xFFFFFFFF)
        there = numbers[word[seen]] >= 0
        count = np.zeros(len(seen), np.int64)
        shard = _pair_shard(number[before[seen]], number[word[seen]], np.append(counts, -1)[before[seen]], m.shards, m.heavy)
        count[there] = self._pairs(pair[there], shard[there])
        left = old[seen, 1:4] @ np.array(m.pair_cuts)
        probability[seen] = (count - self._cut(count, m.pair_cuts) + left * probability[seen]) / old[seen, 0]

        starts = np.cumsum(sizes) - sizes
        sums = lambda values: np.add.reduceat(values, starts)
        return [sizes, sums((counts[place] > 0).astype(np.int64)), sums(base[place]), sums(np.log10(probability)[back])]


_SCORE = "n_tokens long, n_known long, base_score double, score double"


def with_score(documents: DataFrame, model: Model, text: str = "text", into: str = "lm") -> DataFrame:
    """``documents`` with a struct: n_tokens, n_known (tokens the model has counted), base_score (log10 probability by single words, 0.1
    added to each count and to that of one unknown word) and score (log10 probability by the model). A null text is an empty one, and
    has its end only. Perplexity is 10 ** (-score / n_tokens)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = worker_cache(("ngrams", model.folder), lambda: Scorer(model))
        for batch in batches:
            texts, columns, held, size = batch.to_pylist(), [], [], 0
            for text in texts:
                held.append(text)
                size += 1 + (len(text) // 5 if text else 0)
                if size >= BLOCK // 3:
                    columns.append(scorer.score(held))
                    held, size = [], 0
            if held:
                columns.append(scorer.score(held))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            arrays = [pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(zip(*columns) if columns else [()] * 4, kinds)]
            yield pa.StructArray.from_arrays(arrays, [c.split()[0] for c in _SCORE.split(", ")])

    return documents.withColumn(into, F.arrow_udf(run, f"struct<{_SCORE.replace(' ', ': ').replace(',:', ',')}>").asNondeterministic()(F.col(f"`{text}`")))
