"""Language identification by compression: the language whose raw-content dictionary makes a text smallest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import held_out, slices, worker_cache

#: Bounds of the learning sample: documents expected per language, characters of each, languages, bytes of a dictionary.
SAMPLE = 200
SAMPLE_CHARACTERS = 1_000
LANGUAGES = 200
DICTIONARY = 131_072
#: Bytes compressed at a time, so that the dictionary counts throughout a long text and not only at its start; compression level.
BLOCK = 2_048
LEVEL = 6
#: A text is rejected where the second language is less than this share larger than the first.
MARGIN = 0.005
UNDETERMINED = "und"
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def prepared(text: str) -> bytes:
    """Lower-cased letters and everything beyond ASCII, in runs with one space between."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def evenly_cut(texts: list[bytes], total: int) -> list[bytes]:
    """Beginnings of the texts, of ``total`` bytes at most with one between each two: all of one length, but for shorter texts, whose
    bytes the others share."""
    left, cut = total - max(0, len(texts) - 1), {}
    for done, k in enumerate(sorted(range(len(texts)), key=lambda k: len(texts[k]))):
        cut[k] = texts[k][: max(0, left) // (len(texts) - done)]
        left -= len(cut[k])
    return [cut[k] for k in range(len(texts))]


def learned_dictionaries(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary per language, from a bounded sample of the rows that are not held out and have text and language.

    Counts per language, over all rows, set the share of its rows to draw; a hash of the id draws them and the place in the whole text
    from which each teaches. The dictionary's bytes are shared evenly, so every drawn document with letters has its part. Languages are taken as they
    come; more than ``LANGUAGES`` raise.
    """
    known = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return {}
    scale = 1 << 40
    limits = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(scale, SAMPLE * scale // n)))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(scale))
    start = F.pmod(F.xxhash64("doc_id", F.lit("span")), F.greatest(F.length("text") - SAMPLE_CHARACTERS, F.lit(0)) + 1).cast("int")
    span = F.col("text").substr(start + 1, F.lit(SAMPLE_CHARACTERS))
    drawn = known.where(place < limits[F.col("lang")]).select("lang", place.alias("place"), span.alias("text")).collect()
    parts: dict[str, list[bytes]] = {name: [] for name in counts}
    for row in sorted(drawn, key=lambda r: (r["lang"], r["place"])):
        if learned := prepared(row["text"]):
            parts[row["lang"]].append(learned)
    return {name: b" ".join(evenly_cut(texts, DICTIONARY)) for name, texts in sorted(parts.items()) if sum(map(len, texts)) >= 8}


def _predictor(shared, key: str):
    def build():
        import zstandard

        options = {"level": LEVEL, "write_checksum": False, "write_dict_id": False, "write_content_size": False}
        raw = {name: zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for name, data in shared.value.items()}
        for each in raw.values():
            each.precompute_compress(level=LEVEL)
        return [(name, zstandard.ZstdCompressor(dict_data=each, **options).compress) for name, each in raw.items()]

    def predict(text: str | None, compressors: list) -> tuple[str, float]:
        if not text or not compressors or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        data = prepared(text)
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(compress(block)) for block in blocks), name) for name, compress in compressors)
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][1], margin

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = worker_cache(key, build)
        for batch in slices(batches):
            found = [predict(text, compressors) for text in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "margin"])

    return F.arrow_udf(run, "lang string, margin double").asNondeterministic()


def with_language(documents: DataFrame, dictionaries: dict[str, bytes], text: str = "text", into: str = "language", margin: float = MARGIN) -> DataFrame:
    """``documents`` with a struct column ``into``: lang, score (0 to 1, rising with the margin), rejected.

    Every whole text is encoded against each dictionary; the smallest total wins, ties go to the first name. ``und`` and rejected: null
    texts, texts without letters, and all texts where nothing was learned. Also rejected: a margin below ``margin``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)
    name = f"__lang_{uuid.uuid4().hex[:8]}"
    out = documents.withColumn(name, _predictor(shared, uuid.uuid4().hex)(F.col(text)))
    narrow = F.col(f"{name}.margin")
    column = F.struct(
        F.col(f"{name}.lang").alias("lang"),
        (1 - F.exp(-narrow / 0.03)).alias("score"),
        ((F.col(f"{name}.lang") == UNDETERMINED) | (narrow < margin)).alias("rejected"),
    )
    return out.withColumn(into, column).drop(name)
