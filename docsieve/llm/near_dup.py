"""Near-duplicate documents by bottom-k sketches of word shingles, every link confirmed on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.llm.common import LOWER_BYTES, saved, slices
from docsieve.llm.components import components

#: Retained values of the first sketch, of every class, and of the second, of classes that have shared values in the first.
K = 32
K_LONG = 512
#: Accepted chance that sampling hides one pair of exactly the least similarity. More similar pairs have a smaller one.
MISS = 1e-12
#: Ids up to this many, at about 24 bytes each, are sent to every task instead of moving the texts to the ids.
BROADCAST_IDS = 1_000_000
#: Values before its own that a list entry remembers. A pair that has met in one of them is not listed again; changes no result.
EARLIER = 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the word shingles; A-Z lower-cased, words are runs without ASCII white space.

    Fewer words than ``words``: the whole sequence is one shingle. No words: empty.
    """
    import xxhash

    if not text:
        return np.empty(0, np.int64)
    found = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not found:
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    if len(found) < words:
        return np.array([digest(b" ".join(found), seed=len(found))], np.uint64).view(np.int64)
    each = np.array([digest(w) for w in found], np.uint64)
    mixed = each[: len(each) - words + 1].copy()
    for k in range(1, words):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += each[k : len(each) - words + 1 + k]
    mixed ^= mixed >> np.uint64(30)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(27)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _sketcher(words: int, k: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for batch in slices(batches):
            sizes, digests, sketches = [], [], []
            for text in batch:
                hashes = shingle_hashes(text.as_py(), words)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sketches.append(hashes[:k].copy())
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _longs(sketches)], ["n", "digest", "sketch"])

    return F.arrow_udf(run, "n long, digest binary, sketch array<long>").asNondeterministic()


def _full_sets(words: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield _longs([shingle_hashes(text.as_py(), words) for text in batch])

    return F.arrow_udf(run, "array<long>").asNondeterministic()


def least_overlap(k: int, percent: int, miss: float = MISS) -> int:
    """Retained values a pair of that similarity has in common at least, but for a chance of ``miss`` (binomial tail; the draw is
    without replacement, which is tighter)."""
    p, total, least = percent / 100, 0.0, 0
    while total + (term := math.comb(k, least) * p**least * (1 - p) ** (k - least)) <= miss:
        total, least = total + term, least + 1
    return least


def _least_shared(n: Column, k: int, percent: int) -> Column:
    """Sketch values a class of n shingles shares with any partner at least. Up to k*percent/100 shingles the partner's sketch
    is its whole set as well, so the bound is exact. From there up to k the union may fill k places or not: where it does not,
    the whole overlap is shared, which can be less than ``least_overlap``, so the smaller bound counts."""
    whole = (n * percent + 99).cast("long")
    exact, sampled = ((whole - whole % 100) / 100).cast("int"), F.lit(least_overlap(k, percent))
    return F.when(n <= k * percent // 100, exact).when(n <= k, F.least(exact, sampled)).otherwise(sampled)


def _confirmed(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule them out and whose full sets are similar enough.

    A set is kept in the order of its hashes, so its sketch is its beginning. The sketch of the union is the k least of both. Only sets of
    classes that are in a pair move.
    """
    pairs = saved(pairs, "candidate-pairs")
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "paired")
    sets = sets.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rep", "left_semi")
    a, b = (sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    met = pairs.join(b, "b").join(a, "a")
    union = F.expr(f"slice(array_sort(array_union(slice(ha, 1, {k}), slice(hb, 1, {k}))), 1, {k})")
    met = met.withColumn("u", F.when((F.size("ha") > k) | (F.size("hb") > k), union))
    shared = F.expr(f"size(array_intersect(array_intersect(slice(ha, 1, {k}), slice(hb, 1, {k})), u))")
    likely = F.col("u").isNull() | (shared >= least_overlap(k, percent))
    exact = F.expr("size(array_intersect(ha, hb))")
    return met.where(likely).withColumn("o", exact).where(F.col("o") * 100 >= (F.size("ha") + F.size("hb") - F.col("o")) * percent).select("a", "b")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, k: int = K, k_long: int = K_LONG, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked, directly or not, by a Jaccard similarity of at least ``percent``.

    1. Documents with equal shingle sets are one class, named by its smallest id. Copies go no further.
    2. Each class retains the ``k`` smallest hashes of its shingles. Inverted lists count the classes of each retained value. A class
       with fewer shared values than any partner must have in common with it (``least_overlap``) leaves.
    3. The rest retains ``k_long`` values, which for most texts are all, and is listed again. A class stays in the lists of its rarest
       shared values only: so many that two classes with enough in common meet in one of them. It leaves a list too where what it has
       left behind the list's value is too little to share with the smallest class there.
    4. Each class is compared with the class of its lists that shares most of itself, which in a group of copies is what they were
       made from. What is confirmed merges most of a group, and lists of one group only are dropped.
    5. The other lists give the pairs across groups, most of them once: not where an earlier value close by has both. The sketch of the union filters, the full shingle sets confirm, and components
       join the links.

    No list, partner or candidate is capped. Sampling may hide a pair at exactly the least similarity with a chance of ``MISS``.
    Null, empty and blank texts have no shingles and are linked with nothing. Rows with one id count as one document. A null id
    gets the component of its equals, else null, and is kept. No rows: no rows.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    sketched = rows.select("doc_id", _sketcher(words, k)(F.col("__text")).alias("s"))
    sketched = saved(sketched.select("doc_id", "s.n", "s.digest", "s.sketch", F.monotonically_increasing_id().alias("row")), "sketches")
    classes = saved(sketched.where("n > 0 and doc_id is not null").groupBy("n", "digest").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row")), "classes")

    # 2
    first = sketched.join(classes.select("row", "rep"), "row").select("rep", "n", F.explode("sketch").alias("v"))
    lists = first.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v")
    alive = first.join(lists, "v").groupBy("rep", "n").agg(F.count("*").alias("r")).where(F.col("r") >= _least_shared(F.col("n"), k, percent))
    alive = saved(alive.select("rep").distinct(), "candidates")
    ids = alive.select(F.col("rep").alias("doc_id"))
    needed = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = needed.select(F.col("doc_id").alias("rep"), _full_sets(words)(F.col("__text")).alias("hashes"))
    sets = saved(sets.where(F.size("hashes") > 0), "sets")

    # 3
    second = sets.select("rep", F.size("hashes").alias("n"), F.explode(F.expr(f"slice(hashes, 1, {k_long})")).alias("v"))
    lists = second.groupBy("v").agg(F.count("*").alias("df"), F.min("n").alias("smallest")).where("df > 1")
    own = Window.partitionBy("rep")
    ranked = second.join(lists, "v").withColumn("r", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "v")))
    least = _least_shared(F.col("n"), k_long, percent)
    # Up to this size all partners' sketches are whole. If a pair first meets in this value, it has none of the rarer values in
    # common; what is left from here on bounds the overlap, and a pair needs percent / (100 + percent) of both sizes.
    whole = F.col("n") <= k_long * percent // 100
    ranked = ranked.withColumn("rest", F.when(whole, F.col("r") - F.col("rank") + 1).otherwise(F.col("n")))
    ranked = ranked.withColumn("share", F.when(whole, F.col("r")).otherwise(F.col("n")))
    fitting = (F.col("n") + F.col("smallest")) * percent <= F.col("rest") * (100 + percent)
    short = ranked.where((F.col("r") >= least) & (F.col("rank") <= F.col("r") - least + 1) & fitting)
    short = saved(short.select("rep", "n", "v", "df", "share", "rest"), "prefixes")

    # 4
    standing = F.struct((F.col("share") / F.col("n")).alias("part"), (-F.col("rep")).alias("low"))
    centres = short.groupBy("v").agg(F.max_by(F.struct("rep", "n"), standing).alias("c")).select("v", F.col("c.rep").alias("a"), F.col("c.n").alias("na"))
    tried = short.join(centres, "v").where(f"a <> rep and 100 * least(n, na) >= {percent} * greatest(n, na)")
    tried = tried.groupBy("rep", "a").count().groupBy("rep").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    merged = saved(_confirmed(tried.select("a", F.col("rep").alias("b")), sets, k_long, percent), "first-links")
    group = components(merged)

    # 5; values come in one order for all classes, and what is left of a class behind a value falls, so a pair that fits where it meets
    # also fits where it met before: it is left to that list
    grouped = short.join(group.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "v", "df", "rest", F.coalesce("component", "rep").alias("g"))
    mixed = grouped.groupBy("v").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("v")
    before = Window.partitionBy("rep").orderBy("df", "v").rowsBetween(-EARLIER, -1)
    grouped = saved(grouped.join(mixed, "v").withColumn("earlier", F.collect_list("v").over(before)).drop("df"), "mixed")
    a, b = (grouped.select("v", F.col("rep").alias(x), *[F.col(c).alias(f"{c[0]}{x}") for c in ("n", "rest", "g", "earlier")]) for x in "ab")
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * least(ra, rb) >= {percent} * (na + nb) and not arrays_overlap(ea, eb)"
    pairs = a.join(b, "v").where(f"a < b and ga <> gb and {fits}").select("a", "b").distinct()
    links = merged.unionByName(saved(_confirmed(pairs, sets, k_long, percent), "links"))

    joined = components(links).withColumnRenamed("node", "rep")
    named = classes.join(joined, "rep", "left").select("n", "digest", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.join(named, ["n", "digest"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
