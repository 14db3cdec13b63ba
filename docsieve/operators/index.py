"""Term search on a stored inverted index.

Postings (term, document, frequency) lie in folders by a hash of the term and are sorted by term and block inside, so a search reads the
folders of its own terms and, by the statistics of the files, little more than their rows. Documents are in blocks by length, since long
documents score highest; for each term and block the largest frequency is kept, and a search for the best few reads blocks from the
highest possible score down and stops where no block left can reach the last of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docsieve.functions.text import tokens
from docsieve.operators.search import SearchQuery

#: Blocks per doubling of a document's length: no index has more blocks than this times 64.
PER_DOUBLING = 4


@dataclass(frozen=True)
class SearchIndex:
    """A stored index: ``postings`` (bucket, term, block, id, tf), ``terms`` (bucket, term, df), ``blocks`` (bucket, term, block, max_tf)."""

    folder: str
    buckets: int
    documents: int
    id_type: str

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        columns = {"postings": f"term string, block int, id {self.id_type}, tf bigint", "blocks": "term string, block int, max_tf bigint, n bigint", "terms": "term string, df bigint"}
        return spark.read.schema(f"{columns[table]}, bucket int").parquet(f"{self.folder}/{table}")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _words(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, block, term): every term of every text, repeated as in it; each text is split once."""
    rows = df.select(F.col(id_column).alias("id"), tokens(F.col(text)).alias("w")).filter(F.col("id").isNotNull())
    block = F.floor(F.log2(F.size("w").cast("double") + 1) * PER_DOUBLING).cast("int")
    # outer, since a test of the array would be pushed below the split and every text split again for it
    return rows.select("id", block.alias("block"), F.explode_outer("w").alias("term")).filter(F.col("term").isNotNull())


def build_index(df: DataFrame, id_column: str, text: str, folder: str, buckets: int = 256) -> SearchIndex:
    """Write the index of ``df`` below ``folder``. Ids are unique; rows without an id are left out, null texts have no terms.

    Frequencies are added up before they are shuffled, and a frequent term's postings are dealt out by block as well, so no task holds
    a term. Reading a term's postings back needs no shuffle.
    """
    counted = _words(df, id_column, text).groupBy("id", "block", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", _bucket(F.col("term"), buckets))
    postings = counted.repartition("bucket", "block").sortWithinPartitions("bucket", "term", "block")
    postings.select("term", "block", "id", "tf", "bucket").write.partitionBy("bucket").parquet(f"{folder}/postings")
    spark = df.sparkSession
    index = SearchIndex(folder, buckets, df.filter(F.col(id_column).isNotNull()).count(), df.schema[id_column].dataType.simpleString())
    best = index.read(spark, "postings").groupBy("bucket", "term", "block").agg(F.max("tf").alias("max_tf"), F.count(F.lit(1)).alias("n"))
    best.repartition("bucket").sortWithinPartitions("term", "block").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    frequency = index.read(spark, "blocks").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    frequency.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{folder}/terms")
    return index


def _of_terms(spark: SparkSession, index: SearchIndex, table: str, words: Sequence[str]) -> DataFrame:
    """Rows of some terms; the folders of other terms are not opened."""
    numbers = spark.range(1).select(*[_bucket(F.lit(word), index.buckets) for word in words]).first()
    return index.read(spark, table).filter(F.col("bucket").isin(*set(numbers)) & F.col("term").isin(*words))


def _hits(postings: DataFrame, query: SearchQuery, weights: dict[str, float]) -> DataFrame:
    """(id, score) of documents the query selects; a document's few postings of the query's terms meet on its id."""
    weight = reduce(lambda rest, word: F.when(F.col("term") == word, F.lit(weights[word])).otherwise(rest), weights, F.lit(0.0))
    has = {word: f"h{number}" for number, word in enumerate(dict.fromkeys(query.scoring + query.must_not))}
    flags = [F.bool_or(F.col("term") == word).alias(name) for word, name in has.items()]
    found = postings.groupBy("id").agg(F.sum(F.col("tf") * weight).alias("score"), *flags)
    test = F.lit(True)
    for word in query.must:
        test = test & F.col(has[word])
    for group in query.should:
        test = test & reduce(lambda a, b: a | b, [F.col(has[word]) for word in group], F.lit(False))
    for word in query.must_not:
        test = test & ~F.col(has[word])
    return found.filter(test).select("id", "score")


def _bounds(spark: SparkSession, index: SearchIndex, query: SearchQuery, weights: dict[str, float]) -> dict[int, float]:
    """Highest possible score per block that can hold a hit, from one small row per term and block."""
    most: dict[int, dict[str, int]] = {}
    for row in _of_terms(spark, index, "blocks", query.scoring).collect():
        most.setdefault(row["block"], {})[row["term"]] = row["max_tf"]
    able = {
        block: held
        for block, held in most.items()
        if all(word in held for word in query.must) and all(any(word in held for word in group) for group in query.should)
    }
    return {block: sum(weights[word] * tf for word, tf in held.items()) for block, held in able.items()}


@dataclass(frozen=True)
class IndexedHits:
    """``hits``: (id, score), best first; ``read`` and ``skipped``: blocks that were read, and that could not reach the best few."""

    hits: DataFrame
    read: tuple[int, ...]
    skipped: tuple[int, ...]


def indexed_search(spark: SparkSession, index: SearchIndex, query: SearchQuery, limit: int | None = None, rows: DataFrame | None = None) -> IndexedHits:
    """What ``search`` gives, by ids and scores: the sum of term frequency times ln(1 + documents / document frequency), ties by id.

    ``rows`` has the ids (column ``id``) that may be found, for tests the index knows nothing of. With a limit, blocks are read in twos,
    fours and so on while one that is left could still reach the last of the best; without one, all that can hold a hit. A query needs a
    word to be found, and field tests belong to ``rows``.
    """
    if not query.scoring or query.fields:
        raise ValueError("an indexed search needs words, and takes field tests as rows")
    known = {row["term"]: row["df"] for row in _of_terms(spark, index, "terms", query.scoring).collect()}
    weights = {word: math.log(1.0 + index.documents / max(known.get(word, 0), 1)) for word in query.scoring}
    bounds = _bounds(spark, index, query, weights)
    order = sorted(bounds, key=lambda block: (-bounds[block], block))
    words = list(dict.fromkeys(query.scoring + query.must_not))

    def hits(blocks: Sequence[int]) -> DataFrame:
        found = _hits(_of_terms(spark, index, "postings", words).filter(F.col("block").isin(*blocks)), query, weights)
        return found if rows is None else found.join(rows.select("id"), "id", "left_semi")

    taken = len(order) if limit is None else 0
    step = 2
    while taken < len(order):
        taken, step = min(len(order), taken + step), step * 2
        if taken == len(order):
            break
        best = hits(order[:taken]).orderBy(F.desc("score")).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).first()
        # scores that differ by rounding tie, so a block has to stay clearly below
        if best["n"] == limit and bounds[order[taken]] < best["last"] - 1e-5:
            break
    out = hits(order[:taken]).orderBy(F.round("score", 6).desc(), "id")
    return IndexedHits(out if limit is None else out.limit(limit), tuple(order[:taken]), tuple(order[taken:]))
