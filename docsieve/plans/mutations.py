"""Queries over updates, deletes, upserts and record differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions.text import tokens
from docsieve.operators import diff, update as up
from docsieve.operators.query import all_of, any_of
from docsieve.operators.update import Update
from docsieve.plans.registry import query, table, work_folder
from docsieve.sources import bucketed

PARTS = "p_partkey, p_name, p_type, CAST(p_size AS BIGINT) AS p_size"


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type", F.col("p_size").cast("bigint").alias("p_size"))


def _docs(spark, d):
    """Documents with their first words as a list field: short lists with repeats."""
    return table(spark, d, "documents").select("doc_id", F.array("lang", "source", "lang").alias("tags"))


@query("m1_set", "SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN 'HUGE' ELSE p_type END AS p_type, CAST(p_size AS BIGINT) AS p_size FROM part")
def m1_set(spark, d):
    return up.update_many(_parts(spark, d), all_of().range_above("p_size", 40, True), Update().set("p_type", "HUGE"))


@query(
    "m2_unset",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END IS NULL AS cleared FROM orders",
)
def m2_unset(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = up.update_many(orders, all_of().when("o_orderstatus", "F"), Update().unset("o_orderpriority"))
    return out.select("o_orderkey", F.col("o_orderpriority").isNull().alias("cleared"))


@query(
    "m3_increment",
    """SELECT d.doc_id, CASE WHEN d.lang = 'fr' THEN COALESCE(l.quality, 0) + 5 ELSE COALESCE(l.quality, -1) END::BIGINT AS quality
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def m3_increment(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = up.update_many(joined, all_of().when("lang", "fr"), Update().increment("quality", 5))
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("bigint").alias("quality"))


@query("m4_add", "SELECT doc_id, concat_ws('|', lang, source, lang, 'new', lang) AS tags FROM documents WHERE lang = 'en'")
def m4_add(spark, d):
    return up.update_and_return(_docs(spark, d), all_of().when("tags", "en"), Update().add("tags", ["new", "en"])).withColumn("tags", F.array_join("tags", "|"))


@query("m5_add_unique", "SELECT doc_id, concat_ws('|', lang, source, lang, 'new') AS tags FROM documents WHERE lang = 'en'")
def m5_add_unique(spark, d):
    changed = up.update_and_return(_docs(spark, d), all_of().when("tags", "en"), Update().add("tags", ["new", "en"], dedup=True))
    return changed.withColumn("tags", F.array_join("tags", "|"))


@query("m6_remove", "SELECT doc_id, source AS tags FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, concat_ws('|', lang, source, lang) FROM documents WHERE lang NOT IN ('en', 'de')")
def m6_remove(spark, d):
    out = up.update_many(_docs(spark, d), all_of().with_any("tags", ["en", "de"]), Update().remove("tags", ["en", "de"]))
    return out.withColumn("tags", F.array_join("tags", "|"))


@query(
    "m6_remove_range_any",
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
        SELECT doc_id, CAST(len(list_filter(w, lambda x: NOT (length(x) BETWEEN 3 AND 8 OR x = 'a'))) AS BIGINT) AS kept FROM t""",
)
def m6_remove_range_any(spark, d):
    words = F.transform(tokens(F.col("text")), lambda word: F.struct(word.alias("word"), F.length(word).alias("size")))
    docs = table(spark, d, "documents").select("doc_id", words.alias("words"))
    out = Update().remove("words", any_of().range_in("size", 3, False, 8, False).when("word", "a")).apply(docs)
    return out.select("doc_id", F.size("words").cast("bigint").alias("kept"))


@query(
    "m6_remove_by_query",
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
        SELECT doc_id, CAST(len(list_filter(w, lambda x: NOT (length(x) > 8 OR x = 'the'))) AS BIGINT) AS kept FROM t""",
)
def m6_remove_by_query(spark, d):
    words = F.transform(tokens(F.col("text")), lambda word: F.struct(word.alias("word"), F.length(word).alias("size")))
    docs = table(spark, d, "documents").select("doc_id", words.alias("words"))
    out = Update().remove("words", any_of().range_above("size", 8, True).when("word", "the")).apply(docs)
    return out.select("doc_id", F.size("words").cast("bigint").alias("kept"))


@query(
    "m7_upsert",
    """SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
       UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def m7_upsert(spark, d):
    stored = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return up.upsert(stored, changes, "id")


@query(
    "m7_touched_buckets",
    """SELECT c_custkey AS id, CASE WHEN c_custkey = 1 THEN 'changed' ELSE c_name END AS name, CAST(1 AS BIGINT) AS rewritten FROM customer WHERE c_custkey <> 2""",
)
def m7_touched_buckets(spark, d):
    # one row deleted, then one replaced: of sixteen buckets, the last change writes one
    folder = work_folder(spark, "customers")
    bucketed.create(spark, folder, "id", 16)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    bucketed.change(spark, folder, customers, delete=None)
    ids = customers.select("id").filter(F.col("id") == 2)
    bucketed.change(spark, folder, delete=ids)
    before = bucketed.manifest(spark, folder).folders
    bucketed.change(spark, folder, customers.filter(F.col("id") == 1).withColumn("name", F.lit("changed")))
    after = bucketed.manifest(spark, folder).folders
    rewritten = sum(1 for number in before | after if before.get(number) != after.get(number))
    return bucketed.read(spark, folder).withColumn("rewritten", F.lit(rewritten).cast("bigint"))


@query(
    "k3_insert_new",
    "SELECT doc_id, 'kept' AS state FROM documents UNION ALL SELECT vec_id, 'added' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
)
def k3_insert_new(spark, d):
    stored = table(spark, d, "documents").select("doc_id", F.lit("kept").alias("state"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("added").alias("state"))
    return up.insert_new(stored, rows, "doc_id")[0]


@query("k3_refused", "SELECT vec_id AS doc_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def k3_refused(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return up.insert_new(table(spark, d, "documents").select("doc_id"), rows, "doc_id")[1]


@query(
    "m8_nested",
    "SELECT c_custkey, n_name || '!' AS nation, CASE WHEN c_mktsegment = 'BUILDING' THEN 'yes' ELSE 'no' END AS flag FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def m8_nested(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.struct("n_name", F.lit("no").alias("flag")).alias("home"))
    docs = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "home")
    named = Update().nested("home", Update().set("n_name", F.concat("home.n_name", F.lit("!")))).apply(docs)
    out = up.update_many(named, all_of().when("c_mktsegment", "BUILDING"), up.from_template({"home": {"flag": "yes", "n_name": None}}))
    return out.select("c_custkey", F.col("home.n_name").alias("nation"), F.col("home.flag").alias("flag"))


@query("m9_update_one", f"SELECT {PARTS.replace('p_name,', '')}, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part WHERE p_type = 'PROMO') THEN 'first' ELSE p_name END AS p_name FROM part")
def m9_update_one(spark, d):
    return up.update_one(_parts(spark, d), all_of().when("p_type", "PROMO"), Update().set("p_name", "first"), "p_partkey")


@query("m9_update_count", "SELECT count(*) AS n FROM part WHERE p_type = 'PROMO' OR p_size IN (1, 2)")
def m9_update_count(spark, d):
    return up.updated_count(_parts(spark, d), any_of().when("p_type", "PROMO").with_any("p_size", [1, 2]))


@query(
    "m10_images",
    "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, 'before' AS image FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, p_size + 100, 'after' FROM part WHERE p_size < 5",
)
def m10_images(spark, d):
    small, grow = all_of().range_below("p_size", 5, True), Update().increment("p_size", 100)
    images = [
        up.update_and_return(_parts(spark, d), small, grow, before).select("p_partkey", "p_size", F.lit("before" if before else "after").alias("image"))
        for before in (True, False)
    ]
    return images[0].unionByName(images[1])


@query("m11_delete", f"SELECT {PARTS} FROM part WHERE NOT (p_type = 'SMALL' AND p_size > 10)")
def m11_delete(spark, d):
    return up.delete_many(_parts(spark, d), all_of().when("p_type", "SMALL").range_above("p_size", 10, True))


@query("m11_delete_one", f"SELECT {PARTS} FROM part WHERE p_partkey <> (SELECT min(p_partkey) FROM part WHERE p_type = 'SMALL')")
def m11_delete_one(spark, d):
    return up.delete_one(_parts(spark, d), all_of().when("p_type", "SMALL"), "p_partkey")


@query(
    "m12_document",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN concat_ws('|', source, 'x') ELSE concat_ws('|', lang, source, lang) END AS tags FROM documents""",
)
def m12_document(spark, d):
    where, change = up.from_update_document({"query": {"when": {"tags": "en"}}, "add": {"tags": ["x", True]}})
    _, cut = up.from_update_document({"remove": {"tags": "en"}})
    docs = _docs(spark, d)
    both = Update(cut.changes + change.changes)
    return up.update_many(docs, where, both).withColumn("tags", F.array_join("tags", "|"))


@query(
    "u6_diff",
    """SELECT COALESCE(d.doc_id, e.vec_id) AS id, 'lang' AS field, d.lang IS NOT NULL AS changed FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id
       UNION ALL SELECT COALESCE(d.doc_id, e.vec_id), 'size', CAST(d.n_chars % 10 AS BIGINT) IS DISTINCT FROM CAST(e.label AS BIGINT) FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def u6_diff(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", (F.col("n_chars") % 10).alias("size"))
    new = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("size"))
    return diff.record_diff(old, new, "id").select("id", F.explode("changed").alias("field", "changed"))


@query(
    "j5_dependents",
    """SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND l_quantity = 50)""",
)
def j5_dependents(spark, d):
    done = all_of().when("l_linestatus", "F").when("l_returnflag", "R").when("l_quantity", 50.0).filter(table(spark, d, "lineitem"))
    return diff.dependents(done, table(spark, d, "orders"), "l_orderkey", "o_orderkey").select("o_orderkey")


