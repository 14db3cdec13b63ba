"""Alignment of two tokenizers' tokens on bytes, worked out once for each different text.

Documents are shuffled by their full text, so copies meet. A different text is tokenised by both files and aligned once; the counts of
its token pairs weigh as much as it has copies, and its measures are joined back to all its documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.bpe import byte_alphabet
from docsieve.llm.common import saved, slices, worker_cache

#: Aligned runs a worker remembers, held twice at most, and the longest run that is remembered.
CACHE = 200_000
LONGEST = 64
#: Token pairs up to this many, at about 40 bytes each, are sent to every task; beyond it pairs meet their counts in a shuffle.
BROADCAST_PAIRS = 4_000_000
_SPACE = "▁"
#: White space with the run behind it.
_RUN = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space, the pattern of byte-level files does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def groups_of(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[list[str], list[tuple[int, int]]]:
    """Groups between byte offsets where tokens of both end, as text, and all overlapping pairs of ids. Both cover the same bytes."""
    if len(a) == 1 or len(b) == 1:  # one group, and the one token overlaps all others
        return [f"{','.join(map(str, a))}|{','.join(map(str, b))}"], [(x, y) for x in a for y in b]
    groups, links = [], []
    if not a:
        return groups, links
    i = j = first_a = first_b = 0
    x, y, left = a[0], b[0], a_size[0] - b_size[0]  # left: bytes the first side's token ends behind the second side's
    while True:
        links.append((x, y))
        if left < 0:
            i += 1
            x = a[i]
            left += a_size[i]
        elif left > 0:
            j += 1
            y = b[j]
            left -= b_size[j]
        else:
            single = i == first_a and j == first_b
            groups.append(f"{x}|{y}" if single else f"{','.join(map(str, a[first_a : i + 1]))}|{','.join(map(str, b[first_b : j + 1]))}")
            first_a = i = i + 1
            first_b = j = j + 1
            if i == len(a):
                return groups, links
            x, y, left = a[i], b[j], a_size[i] - b_size[j]


class Aligner:
    """Aligns texts of a byte-level file of the tokenizers library (A) with a byte-fallback BPE file of sentencepiece (B).

    A run of white space and what follows it up to the next white space is tokenised alone, by either file, as in its text: no word of
    A's pattern reaches into white space behind it, and no piece of B has white space behind anything else. Files are checked for that;
    texts with white space for which it does not hold are tokenised whole.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        entries = [names.get(i, "") for i in range(max(names) + 1)]
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entries]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace(_SPACE, " ").encode() for p, is_byte in pieces]
        plain = [p for i, (p, is_byte) in enumerate(pieces) if len(p) > 1 and not is_byte and not self.b.is_control(i) and not self.b.is_unknown(i)]
        blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        mixed = {c for c in blanks if any(c in p for p in plain)}
        self.whole = any(_SPACE in p.lstrip(_SPACE) for p in plain)
        self.odd = re.compile("[" + re.escape("".join(sorted(mixed | set(_SEPARATORS)))) + "]")
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}  # what was known before ``known`` was full; what is met again moves over

    def _b_ids(self, runs: list[str]) -> list[list[int] | None]:
        """B's ids of each run; B puts a space before everything it is given. None where that space does not stand alone."""
        found = self.b.encode([run[1:] if run[0] == " " else run for run in runs], num_threads=1)
        return [ids if run[0] == " " else ids[1:] if ids and self.b_bytes[ids[0]] == b" " else None for run, ids in zip(runs, found)]

    def _entry(self, run: str, a: list[int], b: list[int] | None) -> tuple | None:
        """(n_a, n_b, n_groups, groups as text, packed pairs) of a run; None where the bytes of either file are not the run's."""
        if b is None:
            return None
        data, a_bytes, b_bytes = run.encode(), [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            return None
        groups, links = groups_of(a, b, list(map(len, a_bytes)), list(map(len, b_bytes)))
        return len(a), len(b), len(groups), ";".join(groups), array("q", [x << 32 | y for x, y in links]).tobytes()

    def align(self, text: str) -> tuple | None:
        """(n_a, n_b, n_groups, groups as text, pairs as a << 32 | b for each link) of space + text; None without tokens."""
        if not text or _SPACE in text:
            return None  # B reads that character as a space
        full = " " + text
        if self.whole or self.odd.search(full):
            entry = self._entry(full, self.a.encode(full, add_special_tokens=False).ids, self._b_ids([full])[0])
            return entry and (*entry[:4], np.frombuffer(entry[4], np.int64))
        runs = _RUN.findall(full)
        if len(runs) > 1 and runs[-1].isspace():
            runs[-2:] = [runs[-2] + runs[-1]]
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = set(runs).difference(known)
        known.update((run, older[run]) for run in missing if run in older)
        new = [run for run in missing if run not in older]
        if new:
            for run, found, b in zip(new, self.a.encode_batch_fast(new, add_special_tokens=False), self._b_ids(new)):
                known[run] = self._entry(run, found.ids, b)
        entries = list(map(known.__getitem__, runs))
        for run in new:
            if len(run) > LONGEST:
                del known[run]
        if None in entries:
            return None
        n_a, n_b, n_groups, groups, pairs = zip(*entries)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), np.frombuffer(b"".join(pairs), np.int64)


_ALIGNED = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, links array<int>"


def _int_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_cache(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in slices(batches, 128):
            rows, pairs, times = [], [], []
            for digest, text, copies in zip(batch["digest"].to_pylist(), batch["text"].to_pylist(), batch["copies"].to_pylist()):
                found = aligner.align(text)
                if found is None:
                    continue
                different, count = np.unique(found[4], return_counts=True)
                rows.append((digest, copies, *found[:3], len(found[4]), hashlib.sha256(found[3].encode()).hexdigest()))
                pairs.append(different)
                times.append(count)
            if rows:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.binary(), *[pa.int64()] * 5, pa.string()])]
                lists = [_int_lists([p >> 32 for p in pairs]), _int_lists([p & 0xFFFFFFFF for p in pairs]), _int_lists(times)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], [c.split()[0] for c in _ALIGNED.split(", ")])

    return run


@dataclass(frozen=True)
class Alignment:
    """``texts``: a row per different text that has tokens, with its SHA-256, copies, measures and its different pairs (``a``, ``b``,
    ``links``: times linked); ``pairs``: (a, b, documents, best): documents that hold the pair linked, and whether that is the most of
    its A id."""

    texts: DataFrame
    pairs: DataFrame


def aligned(documents: DataFrame, path_a: str, path_b: str, text: str = "text") -> Alignment:
    """Align each different text of ``documents`` once, and count its token pairs with the number of its copies.

    Both files encode space + text without special tokens, B by its own leading space. Null and empty texts, and texts whose joined
    token bytes are not the text's, have no tokens and are in neither table. A group of copies is one row before it meets others, so no
    text is too frequent for a task.
    """
    different = documents.select(F.col(text).alias("text")).where("text is not null and text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    hashed = different.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text", "copies")
    texts = saved(hashed.mapInArrow(_align(path_a, path_b), _ALIGNED), "aligned-texts")
    each = texts.select("copies", F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("copies").alias("documents"))
    each = saved(each, "pair-counts")
    most = each.groupBy("a").agg(F.max("documents").alias("most"))
    pairs = each.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))
    return Alignment(texts, saved(pairs, "pairs"))


def with_alignment(documents: DataFrame, alignment: Alignment, text: str = "text", into: str = "alignment") -> DataFrame:
    """``documents`` with a struct: n_a, n_b, n_groups, n_links, n_best (links whose pair is its A id's most frequent, ties included),
    count_sum (documents of the pair, summed over links), groups_sha256. Without tokens zeros and an empty text."""
    pair = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair")
    counts = alignment.pairs.select(pair, "documents", "best")
    links = alignment.texts.select("digest", F.explode(F.arrays_zip("a", "b", "links")).alias("p")).select("digest", "p.*").select("digest", pair, "links")
    few = alignment.pairs.count() <= BROADCAST_PAIRS
    sums = links.join(F.broadcast(counts) if few else counts, "pair").groupBy("digest").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum")
    )
    measures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    known = alignment.texts.drop("a", "b", "links", "copies").join(sums, "digest")
    whole = F.struct(*[F.col(f"__m.{name}").alias(name) for name in (*measures, "groups_sha256")])
    none = F.struct(*[F.lit(0).cast("long").alias(name) for name in measures], F.lit("").alias("groups_sha256"))
    known = known.select(F.col("digest").alias("__digest"), F.struct(*measures, "groups_sha256").alias("__m"))
    hashed = documents.withColumn("__digest", F.unhex(F.sha2(F.col(f"`{text}`").cast("binary"), 256)))
    joined = hashed.join(known, "__digest", "left")
    return joined.withColumn(into, F.when(F.col("__m").isNull(), none).otherwise(whole)).drop("__digest", "__m")
