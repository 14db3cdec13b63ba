"""Phrase collocations from a weighted de Bruijn graph of words.

Only phrases of the greatest length are counted: each is an edge from the node of its first words to the node of its last ones. A
phrase one word shorter occurs as often as edges leave its node, plus the pieces of text that end with it; so all shorter counts are
sums over the edges and a few corrections a piece. Nodes that one edge of their own weight enters and leaves lie inside a path, which
is kept as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import saved, slices

#: Words a worker gathers before it adds up their edges; below 2^21, so that three word numbers fit 63 bits.
BLOCK = 1_500_000
#: Byte table: A-Z lower-cased, marks that end a piece a line feed, tabs blanks.
_PIECES = bytes(10 if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_GRAMS = "bucket int, lang string, gram string, n long"
#: Edges are dealt out by their node into so many buckets. Documents drawn to find words that hold one word place in ``FREQUENT`` or
#: more, of which there are no more than that: nodes of such words alone are spread by the edge's last word. Neither changes a result.
BUCKETS = 1 << 16
DRAWN = 2000
FREQUENT = 1000


class _Numbers(dict):
    """Numbers for words as they come; 0 ends a piece, 1 is nothing between two blanks."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Block:
    """Words of one language, as numbers."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, text: str) -> None:
        words = text.encode("utf-8", "surrogatepass").translate(_PIECES).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        ids = ids[ids != 1]
        self.parts.append(ids)
        self.size += len(ids)

    def grams(self, lang: str, longest: int, frequent: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
        """Edges (``longest`` words) and, for each shorter length, the ends of pieces, each with its count, in the order of the words.

        The bucket is one of the node an edge leaves or a piece ends in; below zero where the node lies in many buckets.
        """
        import xxhash

        if not self.size:
            return
        ids = np.concatenate([*self.parts, np.zeros(longest, np.int64)])
        words = np.array(list(self.numbers), object)[2:]
        order = np.argsort(words)
        words = words[order]
        rank = np.zeros(len(words) + 2, np.int64)
        rank[order + 2] = np.arange(1, len(words) + 1)
        ranks = rank[ids]  # 0 ends a piece
        table = pa.array(words, pa.binary())
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        common = np.fromiter((word in frequent for word in words), bool, len(words))
        total = len(ids) - longest
        for length in range(1, longest + 1):
            at = np.flatnonzero(np.logical_and.reduce([ranks[k : total + k] > 0 for k in range(length)]))
            if length < longest:
                at = at[ranks[at + length] == 0]
            if not len(at):
                continue
            code = ranks[at]
            for k in range(1, length):
                if int(code.max() + 1) * (len(words) + 1) >= 1 << 62:
                    code = np.unique(code, return_inverse=True)[1]
                code = code * (len(words) + 1) + ranks[at + k]
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            places = [ranks[at[first] + k] - 1 for k in range(length)]
            node = places[: longest - 1] or places
            spread = np.logical_and.reduce([common[p] for p in node])
            mixed = np.full(len(first), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
            for p in node:
                mixed = _mixed(mixed, hashes[p])
            if length == longest > 1:
                mixed = np.where(spread, _mixed(mixed, hashes[places[-1]]), mixed)
            bucket = (mixed % np.uint64(BUCKETS)).astype(np.int32)
            columns = [table.take(pa.array(p)) for p in places]
            grams = pc.binary_join_element_wise(*columns, b" ") if length > 1 else columns[0]
            langs = pa.repeat(pa.scalar(lang, pa.string()), len(first))
            arrays = [pa.array(np.where(spread, -1 - bucket, bucket)), langs, grams.cast(pa.string()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "lang", "gram", "n"])


def _mixed(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    state = (state ^ value) * np.uint64(0x9E3779B97F4A7C15)
    return state ^ (state >> np.uint64(31))


def _edges(longest: int, frequent: frozenset[bytes] = frozenset()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        for batch in slices(batches):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if text:
                    blocks.setdefault(lang, _Block()).add(text)
            if sum(block.size for block in blocks.values()) >= BLOCK:
                for lang, block in blocks.items():
                    yield from block.grams(lang, longest, frequent)
                blocks = {}
        for lang, block in blocks.items():
            yield from block.grams(lang, longest, frequent)

    return run


def frequent_words(rows: DataFrame) -> frozenset[bytes]:
    """Words with a share of at least one in ``FREQUENT`` in a draw of about ``DRAWN`` of ``rows`` (lang, text): never more words than that."""
    drawn = rows.sample(min(1.0, DRAWN / max(rows.count(), 1)), seed=1)
    counts = drawn.mapInArrow(_edges(1), _GRAMS).groupBy("gram").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(row["gram"].encode() for row in counts.where(F.col("n") * FREQUENT >= total).select("gram").collect())


def _words(gram: str | Column) -> Column:
    return F.split(gram, " ")


def _first(gram: str, count: str) -> Column:
    """First ``count`` words (an SQL expression); the whole gram where it has no more."""
    return F.expr(f"substring_index({gram}, ' ', {count})")


def _last(gram: str, count: str) -> Column:
    return F.expr(f"substring_index({gram}, ' ', -({count}))")


_SHORTER = "size(split(gram, ' ')) - 1"


def phrase_counts(documents: DataFrame, max_words: int = 3, min_count: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n): phrases of 1 to ``max_words`` words that occur at least ``min_count`` times, and per language the empty phrase,
    whose count is the number of words.

    Text is lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, these into words at blanks and tabs. Each task adds up
    edges and piece ends of a block of words. Those of a node meet in one bucket, where edges are summed and each gives its count to the
    phrases it begins with, down to the empty one; so do the ends of pieces. Rare nodes end there. A null language is ``und``. Null and empty texts have no words.
    """
    rows = documents.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    edges = rows.mapInArrow(_edges(max_words, frequent_words(rows)), _GRAMS).repartition("bucket").groupBy("bucket", "lang", "gram").agg(F.sum("n").alias("n"))
    begins = [_first("gram", str(k)) for k in range(max_words)]
    # an end of a piece is shorter than an edge, so it is its own longest beginning; of an edge only frequent ones are needed
    own = F.when(F.col("n") >= min_count, F.col("gram"))
    flows = edges.select("bucket", "lang", "n", F.explode(F.array_distinct(F.array(*begins, own))).alias("gram")).where("gram is not null")
    flows = flows.groupBy("bucket", "lang", "gram").agg(F.sum("n").alias("n"))
    # what flows through a node of one bucket is known there
    node = F.size(_words("gram")) == max_words - 1
    kept = flows.where((F.col("bucket") < 0) | (F.col("gram") == "") | ~node | (F.col("n") >= min_count)) if max_words > 2 else flows
    return kept.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | (F.col("gram") == ""))


def compact_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, path, n, words): the graph with each chain of edges through nodes that one edge of the node's own weight enters and one
    leaves put together. ``edges`` and ``nodes`` are (lang, gram, n), nodes one word shorter.

    Edges point to the one before them and jump twice as far each round, in tables, until all know the first of their chain. No chain
    is a circle, since every occurrence of a node of a circle would need one before it. A path is no longer than a piece of one text.
    """
    e = edges.select("lang", "gram", "n", _first("gram", _SHORTER).alias("head"), _last("gram", _SHORTER).alias("tail"))
    enters = e.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("ins"), F.max("n").alias("w_in"), F.max("gram").alias("before"))
    leaves = e.groupBy("lang", F.col("head").alias("node")).agg(F.count("*").alias("outs"), F.max("n").alias("w_out"))
    node = nodes.select("lang", F.col("gram").alias("node"), "n")
    inner = enters.join(leaves, ["lang", "node"]).join(node, ["lang", "node"]).where("ins = 1 and outs = 1 and w_in = n and w_out = n")
    inner = inner.select("lang", F.col("node").alias("head"), "before")
    linked = saved(e.join(inner, ["lang", "head"], "left").select("lang", "gram", "n", F.coalesce("before", "gram").alias("first"), F.col("before").isNotNull().cast("long").alias("steps")), "chains")
    while True:
        far = linked.select("lang", F.col("gram").alias("first"), F.col("first").alias("further"), F.col("steps").alias("more")).where("more > 0")
        if far.isEmpty():
            break
        jumped = linked.join(far, ["lang", "first"], "left")
        jumped = jumped.select("lang", "gram", "n", F.coalesce("further", "first").alias("first"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("more").isNotNull().alias("moved"))
        jumped = saved(jumped, "chains")
        linked = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    chain = linked.groupBy("lang", "first", "n").agg(F.array_sort(F.collect_list(F.struct("steps", _last("gram", "1").alias("word")))).alias("chain"))
    rest = F.transform(F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0))), lambda step: step["word"])
    path = F.concat(_words("first"), rest)
    return chain.select("lang", F.array_join(path, " ").alias("path"), "n", F.size(path).cast("long").alias("words"))


def collocations(
    documents: DataFrame, max_words: int = 3, min_count: int = 10, covered: int = 50, top: int | None = 2000, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``max_words`` words that occur at least ``min_count`` times.

    A cut after the first k words gives floor(10^6 a^2 / (l r)) with a, l and r the counts of the phrase and its two parts; the cut with
    the lowest score counts, the first of equals. A phrase inside a longer one that occurs at least ``covered`` percent as often is
    dropped. All of a language's phrases, or the ``top`` first by score, count and bytes of the phrase, are ranked; each task hands on
    that many a language at most. Counts are exact up to 10^15. No rows: no rows.
    """
    phrases = saved(phrase_counts(documents, max_words, min_count, lang, text).withColumn("m", F.when(F.col("gram") == "", 0).otherwise(F.size(_words("gram")))), "phrases")
    edges, nodes = (phrases.where(F.col("m") == k).select("lang", "gram", "n") for k in (max_words, max_words - 1))
    paths = saved(compact_paths(edges, nodes).withColumn("path", _words("path")), "paths")

    # the longest phrases are the windows of the paths; nodes inside a path are covered by the edges beside them
    def windows(size: int, begin: int, end: int) -> DataFrame:
        places = F.sequence(F.lit(begin), F.col("words").cast("int") - size + 1 - end)
        wide = paths.where(F.col("words") >= size + begin - 1 + end)
        return wide.select("lang", "n", "path", F.explode(places).alias("at")).select("lang", F.array_join(F.slice("path", F.col("at"), size), " ").alias("gram"), "n")

    candidates = phrases.where("m >= 2").where(F.col("m") < max_words).select("lang", "gram", "n", "m")
    if max_words > 2:
        candidates = candidates.join(windows(max_words - 1, 2, 1).select("lang", "gram").distinct(), ["lang", "gram"], "left_anti")
    # a longer phrase is no more frequent than the one inside it, so the next length decides; of a path its two ends are left
    longer = phrases.where(F.col("m").between(3, max_words - 1)).select("lang", "gram", "n")
    parts = F.array(_first("gram", _SHORTER), _last("gram", _SHORTER))
    beside = longer.select("lang", "n", F.explode(parts).alias("gram"))
    ends = F.array(F.array_join(F.slice("path", 1, max_words - 1), " "), F.array_join(F.slice("path", 1 - max_words, max_words - 1), " "))
    beside = beside.unionByName(paths.select("lang", "n", F.explode(ends).alias("gram")))
    most = beside.groupBy("lang", "gram").agg(F.max("n").alias("longer"))
    candidates = candidates.join(most, ["lang", "gram"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * covered))
    longest = windows(max_words, 1, 0).withColumn("m", F.lit(max_words))
    candidates = candidates.select("lang", "gram", "n", "m").unionByName(longest)

    cuts = candidates.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _first("phrase", "k"), "right": _last("phrase", "m - k")})
    part = phrases.where("m > 0")
    cuts = cuts.join(part.select("lang", F.col("gram").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("gram").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = "cast({0} as decimal(16,0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast({exact.format('a')} * {exact.format('a')} as decimal(31,0)) * 1000000bd) div ({exact.format('l')} * {exact.format('r')})"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    words = phrases.where("m = 0").select("lang", F.col("n").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
