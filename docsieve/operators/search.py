"""Term search with scores, and facets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from docsieve.functions.text import has_word, query_words, word_count
from docsieve.operators.ordered import first_rows
from docsieve.operators.query import Query, sort_columns


@dataclass(frozen=True)
class SearchQuery:
    """Terms: all of ``must``, one of each group of ``should``, none of ``must_not``; ``fields`` are exact ``field:value`` tests."""

    must: tuple[str, ...] = ()
    should: tuple[tuple[str, ...], ...] = ()
    must_not: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def scoring(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.must + tuple(word for group in self.should for word in group)))


def parse_search(text: str) -> SearchQuery:
    """``a b -c d|e field:value``: words are required, ``-`` forbids, each ``x|y`` offers a choice of its own. Words are cut like texts are."""
    must, should, must_not, fields = [], [], [], []
    for word in text.split():
        if ":" in word:
            name, _, value = word.partition(":")
            fields.append((name, value.lower()))
        elif word.startswith("-"):
            must_not += query_words(word)
        elif "|" in word:
            should.append(tuple(query_words(word)))
        else:
            must += query_words(word)
    return SearchQuery(tuple(must), tuple(should), tuple(must_not), tuple(fields))


def _matching(df: DataFrame, text: str, query: SearchQuery, where: Query | None) -> DataFrame:
    """Rows the query selects; every test is a plain predicate on the text, so nothing is split into terms."""
    rows = where.filter(df) if where else df
    for name, value in query.fields:
        rows = rows.filter(F.lower(F.col(name).cast("string")) == value)
    lowered = F.lower(F.col(text))
    for word in query.must:
        rows = rows.filter(has_word(lowered, word))
    for group in query.should:
        rows = rows.filter(reduce(lambda a, b: a | b, [has_word(lowered, word) for word in group], F.lit(False)))
    for word in query.must_not:
        rows = rows.filter(~has_word(lowered, word))
    return rows


def search_hits(df: DataFrame, text: str, query: SearchQuery, where: Query | None = None) -> DataFrame:
    """Matching rows; ``where`` filters without scoring and reaches the scan."""
    return _matching(df, text, query, where)


def search(
    df: DataFrame,
    text: str,
    query: SearchQuery,
    where: Query | None = None,
    order: Sequence[tuple[str, int]] = (),
    tie: str | None = None,
    limit: int | None = None,
    skip: int = 0,
    fields: Sequence[str] = (),
) -> DataFrame:
    """Hits by score (sum of term frequency times inverse document frequency) or by ``order``.

    The query's few words are counted in place, so scoring needs no shuffle: one aggregate row over the corpus gives the document
    frequencies, and the second pass scores and takes the top rows. In ``order`` a negative sign is ascending; with an order
    given, the corpus pass is left out and the score is not computed. All hits come back unless ``limit`` is given.
    """
    words = query.scoring
    hits = _matching(df, text, query, where)
    if order:
        columns = sort_columns(hits.schema, [(name, 1 if sign < 0 else -1) for name, sign in order])
    else:
        if words:
            lowered = F.lower(F.col(text))
            frequencies = [F.count_if(has_word(lowered, word)).alias(f"d{index}") for index, word in enumerate(words)]
            stats = df.agg(F.struct(F.count(F.lit(1)).alias("n"), *frequencies).alias("s")).scalar()
            parts = [
                word_count(lowered, word) * F.log(F.lit(1.0) + stats.getField("n") / F.greatest(stats.getField(f"d{index}"), F.lit(1)))
                for index, word in enumerate(words)
            ]
            score = reduce(lambda a, b: a + b, parts)
        else:
            score = F.lit(0.0)
        hits = hits.withColumn("score", score)
        # ties in the rounded score fall back to the tie column, so that the cut is the same on every run
        columns = [F.round("score", 6).desc()]
    if tie:
        columns.append(F.col(tie).asc())
    out = hits.orderBy(*columns)
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    if not fields:
        return out
    return out.select(*fields) if order else out.select(*fields, "score")


def search_count(df: DataFrame, text: str, query: SearchQuery, where: Query | None = None) -> DataFrame:
    return search_hits(df, text, query, where).agg(F.count(F.lit(1)).alias("n"))


def search_with_facets(
    df: DataFrame, text: str, query: SearchQuery, facet_fields: Sequence[str], top: int | None = None, where: Query | None = None, **page
) -> tuple[DataFrame, DataFrame]:
    """(hits, facets): the page of hits ``search`` gives, and facets over all hits, whatever the page."""
    return search(df, text, query, where, **page), facets(search_hits(df, text, query, where), facet_fields, top)


def facets(df: DataFrame, fields: Sequence[str], top: int | None = None) -> DataFrame:
    """Per field its values (the ``top`` most frequent, if given, ties by value): (field, term, n). Array fields count each distinct item.

    Scalar fields share one pass; an array field has its own, which reads only that column.
    """
    arrays = [name for name in fields if isinstance(df.schema[name].dataType, T.ArrayType)]
    scalars = [name for name in fields if name not in arrays]
    parts = []
    if scalars:
        pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"`{name}`").cast("string").alias("term")) for name in scalars])
        parts.append(df.select(F.explode(pairs).alias("p")).select("p.field", "p.term").groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")))
    for name in arrays:
        terms = df.select(F.explode(F.array_distinct(F.col(f"`{name}`"))).alias("term")).select(F.col("term").cast("string").alias("term"))
        parts.append(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("field"), "term", "n"))
    counted = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("term").isNotNull())
    return counted if top is None else first_rows(counted, ["field"], [F.desc("n"), F.asc("term")], top)
