"""Shards and slots from a keyed permutation of row numbers (columns and aggregates only).

Rows get gapless global numbers, a Feistel network permutes the numbers, and the permuted number alone gives shard and slot: whoever
knows a row's number, the number of rows and the seed can compute where the row went without a lookup, and back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.llm.common import saved

#: Modulus of the round function, 2^31 - 1: products of two residues fit a long.
PRIME = 2_147_483_647
ROUNDS = 6
#: Steps of the cycle walk. Fewer than sqrt(rows) numbers lie outside, so up to 2^12 rows no walk is longer, and above that each
#: step stays outside with probability under 1/64; a walk that were longer raises, it never gives a wrong place.
WALK = 64
#: Expected rows of a numbering bucket.
BUCKET_ROWS = 1024


def round_keys(seed: int) -> list[int]:
    """One key per round, by a linear congruential step from the seed."""
    keys, key = [], seed % PRIME
    for _ in range(ROUNDS):
        key = (key * 48_271 + 11) % PRIME
        keys.append(key)
    return keys


def radices(rows: int) -> tuple[int, int]:
    """(a, b) with a >= b and rows <= a * b < rows + a."""
    a = max(1, int(rows**0.5))
    while a * a < rows:
        a += 1
    return a, max(1, -(-rows // a))


def permuted(number: str, rows: int, seed: int = 1) -> Column:
    """The place of a row number (column ``number``, 0 .. rows-1) under the keyed permutation of 0 .. rows-1.

    Each round maps the halves (x, y) to (y, (x + f(y)) mod the radix of x). The network permutes 0 .. a*b-1; cycle walking, that is
    applying it again while the result is not below ``rows``, restricts it to 0 .. rows-1.
    """
    a, b = radices(rows)
    rounds = ", ".join(f"named_struct('k', {k}L, 'c', {k // 2 + 1}L, 'r', {b if i % 2 else a}L)" for i, k in enumerate(round_keys(seed)))
    t = f"((s.y + r.k) % {PRIME}L)"
    mixed = f"(({t} * {t}) % {PRIME}L) * (({t} + r.c) % {PRIME}L) % {PRIME}L"

    def once(p: str) -> str:
        return (
            f"reduce(array({rounds}), named_struct('x', {p} div {b}L, 'y', {p} % {b}L), "
            f"(s, r) -> named_struct('x', s.y, 'y', (s.x + {mixed}) % r.r), s -> s.x * {b}L + s.y)"
        )

    walked = f"reduce(sequence(1, {WALK}), {once(number)}, (p, i) -> if(p < {rows}L, p, {once('p')}))"
    return F.expr(f"transform(array({walked}), p -> if(p < {rows}L, p, raise_error('cycle walk too long')))[0]")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``row_number``: gapless from 0 over all rows, fixed by the values of ``keys`` alone.

    Equal rows are counted together before the shuffle, so a repeated row is one row here whatever its share of the table, and get
    consecutive numbers. Buckets by hash hold about ``BUCKET_ROWS`` different rows each; two levels of running sums over bucket
    totals (about the square root of the number of buckets in one task) give every bucket its first number.
    """
    counted = saved(rows.groupBy(*keys).agg(F.count("*").alias("__m")), "sharding-rows")
    distinct = counted.count()
    buckets = max(1, distinct // BUCKET_ROWS)
    width = max(1, int(buckets**0.5))
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    placed = counted.withColumn("__b", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % buckets)
    totals = placed.groupBy("__b").agg(F.sum("__m").alias("n")).withColumn("__s", F.expr(f"__b div {width}"))
    inner = totals.withColumn("before", F.sum("n").over(Window.partitionBy("__s").orderBy("__b")) - F.col("n"))
    outer = totals.groupBy("__s").agg(F.sum("n").alias("n"))
    outer = outer.select("__s", (F.sum("n").over(Window.orderBy("__s")) - F.col("n")).alias("base"))
    first = inner.join(outer, "__s").select("__b", (F.col("base") + F.col("before")).alias("first"))
    order = Window.partitionBy("__b").orderBy(*[F.asc_nulls_first(k) for k in keys])
    within = placed.withColumn("__w", F.sum("__m").over(order) - F.col("__m"))
    spread = within.join(first, "__b").withColumn("__i", F.explode(F.expr("sequence(0L, __m - 1)")))
    return spread.select(*keys, (F.col("first") + F.col("__w") + F.col("__i")).alias("row_number"))


def shards(documents: DataFrame, n_shards: int = 8, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard): every row in one shard, law ``rows``.

    shard = place mod n_shards and slot = place div n_shards of the permuted row number, so shard counts are at most one apart and
    slots are gapless from 0. ``size`` is the text's UTF-8 bytes plus 1; a null text has size 1 and CRC 0. Null ids are rows like
    others. Rows equal in id, size and CRC take different places. ``grown_shard`` is null: this law does not promise stable shards
    when their number grows. An empty table gives no rows. Equal texts are not kept together.
    """
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = documents.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"))
    with_numbers = saved(numbered(rows, ["doc_id", "size", "text_crc32"]), "sharding-numbers")
    total = with_numbers.count()
    place = permuted("row_number", max(1, total), seed)
    return with_numbers.withColumn("place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
