"""Benchmark decontamination: one automaton over normalised benchmark passages, each text scanned once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import WORD_BYTES, slices, worker_cache

#: The words of a text in its original spelling, for offsets; the same cuts as WORD_BYTES makes.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RESULT = "n_words long, items array<string>, runs array<struct<word_start: int, word_end: int, char_start: int, char_end: int>>"
_ARROW_RUN = pa.struct([(name, pa.int32()) for name in ("word_start", "word_end", "char_start", "char_end")])
#: Largest benchmark, in bytes of text, that goes into one automaton. About 40 bytes of memory a byte of text.
AUTOMATON_BYTES = 8_000_000


def normalised_words(text: str) -> list[bytes]:
    """Words of digits, letters a-z (A-Z lower-cased) and everything from U+0080 on."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def build_automaton(items: list[tuple[str, str | None]], window: int):
    """(word numbers, automaton over word numbers or None). A pattern's value is (its words, the items that hold it)."""
    import ahocorasick

    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        words = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in normalised_words(text or ""))
        for start in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(words[start : start + window], set()).add(item_id)
    if not windows:
        return vocabulary, None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, holders in windows.items():
        automaton.add_word(words, (len(words), tuple(holders)))
    automaton.make_automaton()
    return vocabulary, automaton


def scan(text: str | None, vocabulary: dict[bytes, int], automaton) -> tuple[int, list[str], list[tuple[int, int, int, int]]]:
    """(words, items that occur, runs of hit words with their offsets in the original text)."""
    if not text:
        return 0, [], []
    words = normalised_words(text)
    if automaton is None or not words:
        return len(words), [], []
    number = vocabulary.get
    hits = list(automaton.iter(tuple([number(w, 0) for w in words])))
    if not hits:
        return len(words), [], []
    items = sorted({item for _, (_, holders) in hits for item in holders})
    runs: list[list[int]] = []
    for start, end in sorted((last - length + 1, last + 1) for last, (length, _) in hits):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    spans = [m.span() for m in _WORD.finditer(text)]
    return len(words), items, [(s, e, spans[s][0], spans[e - 1][1]) for s, e in runs]


def _scanner(shared, key: str, window: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, automaton = worker_cache(key, lambda: build_automaton(shared.value, window))
        for batch in slices(batches):
            found = [scan(text.as_py(), vocabulary, automaton) for text in batch]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.list_(pa.string())),
                    pa.array([[dict(zip(_ARROW_RUN.names, r)) for r in f[2]] for f in found], pa.list_(_ARROW_RUN)),
                ],
                ["n_words", "items", "runs"],
            )

    return F.arrow_udf(run, _RESULT).asNondeterministic()  # evaluated once, also under filters


#: Runs of several automata into disjoint ones.
_MERGED = """reduce(array_sort(flatten(array({runs}))), cast(array() as array<struct<word_start: int, word_end: int, char_start: int, char_end: int>>),
 (done, r) -> if(size(done) > 0 and element_at(done, -1).word_end >= r.word_start,
   concat(slice(done, 1, size(done) - 1), array(named_struct('word_start', element_at(done, -1).word_start, 'word_end', greatest(element_at(done, -1).word_end, r.word_end),
     'char_start', element_at(done, -1).char_start, 'char_end', greatest(element_at(done, -1).char_end, r.char_end)))),
   concat(done, array(r))))"""


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    into: str = "contamination", automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """``documents`` with a struct column ``into``: n_words, n_hit, items (sorted, as strings), spans (offsets in the text).

    A window is ``window`` consecutive words of an item; a shorter item with words is one window. A document word in any occurrence of
    a window is hit. The benchmark is the bounded side: its items go to the workers, ``automaton_bytes`` of text to an automaton; a larger
    benchmark makes several automata, and each text is scanned by each. Null and empty texts have no words; null items and items
    without words match nothing; a null item id is written as the empty string; repeated items count once. No benchmark rows: no hits.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("i")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // automaton_bytes))
    out, names = documents, []
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).distinct().collect()
        shared = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in rows])
        names.append(f"__scan{part}_{uuid.uuid4().hex[:8]}")
        out = out.withColumn(names[-1], _scanner(shared, uuid.uuid4().hex, window)(F.col(text)))
    runs = F.col(f"{names[0]}.runs") if parts == 1 else F.expr(_MERGED.format(runs=", ".join(f"{n}.runs" for n in names)))
    found = F.col(f"{names[0]}.items") if parts == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names]))))
    out = out.withColumn("__runs_" + names[0], runs)
    runs = F.col("__runs_" + names[0])
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda total, r: total + r["word_end"] - r["word_start"])
    spans = F.transform(runs, lambda r: F.struct(r["char_start"].alias("start"), r["char_end"].alias("end")))
    column = F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), hit.alias("n_hit"), found.alias("items"), spans.alias("spans"))
    return out.withColumn(into, column).drop(*names, "__runs_" + names[0])


def is_contaminated(n_words, n_hit, share: int = 20):
    """Some word is hit, and at least one in ``share``."""
    return (n_hit > 0) & (n_hit * share >= n_words)
