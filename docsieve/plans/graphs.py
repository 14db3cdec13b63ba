"""Queries over term search, facets and graph decomposition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docsieve.functions.text import tokens
from docsieve.operators import graph, index, search
from docsieve.operators.graph import EdgeRule, VertexRule
from docsieve.operators.grouped import GroupReducer
from docsieve.operators.query import all_of
from docsieve.plans.registry import query, table, work_folder

TERMS = r"t AS (SELECT doc_id, lang, source, n_chars, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)"


def _scored(words: list[str], where: str, tail: str, columns: str = "doc_id") -> str:
    idf = ", ".join(f"ln(1.0 + count(*) / greatest(count(*) FILTER (WHERE list_contains(w, '{word}')), 1)) AS i{n}" for n, word in enumerate(words))
    score = " + ".join(f"len(list_filter(w, lambda x: x = '{word}')) * i{n}" for n, word in enumerate(words))
    return f"WITH {TERMS}, c AS (SELECT {idf} FROM t), s AS (SELECT {columns}, {score} AS s FROM t, c WHERE {where}) SELECT {columns}, round(s, 4) AS score FROM s {tail}"


@query("q1_search", _scored(["the", "and"], "list_contains(w, 'the') AND list_contains(w, 'and')", "ORDER BY round(s, 6) DESC, doc_id LIMIT 40"))
def q1_search(spark, d):
    found = search.search(table(spark, d, "documents"), "text", search.parse_search("the and"), tie="doc_id", limit=40, fields=["doc_id"])
    return found.withColumn("score", F.round("score", 4))


@query(
    "q1_search_any_not",
    _scored(["le", "la"], "lang = 'fr' AND (list_contains(w, 'le') OR list_contains(w, 'la')) AND NOT list_contains(w, 'pour') AND n_chars > 200", ""),
)
def q1_search_any_not(spark, d):
    wanted = search.parse_search("le|la -pour lang:fr")
    where = all_of().range_above("n_chars", 200, True)
    found = search.search(table(spark, d, "documents"), "text", wanted, where, limit=None, fields=["doc_id"], tie="doc_id")
    return found.withColumn("score", F.round("score", 4))


@query(
    "q1_search_ordered",
    f"WITH {TERMS} SELECT doc_id, n_chars FROM t WHERE list_contains(w, 'and') ORDER BY n_chars, doc_id LIMIT 20 OFFSET 10",
)
def q1_search_ordered(spark, d):
    docs = table(spark, d, "documents")
    return search.search(docs, "text", search.parse_search("and"), order=[("n_chars", -1)], tie="doc_id", skip=10, limit=20).select("doc_id", "n_chars")


@query(
    "q1_search_groups",
    f"WITH {TERMS} SELECT doc_id FROM t WHERE (list_contains(w, 'the') OR list_contains(w, 'le')) AND (list_contains(w, 'and') OR list_contains(w, 'la'))",
)
def q1_search_groups(spark, d):
    return search.search_hits(table(spark, d, "documents"), "text", search.parse_search("the|le and|la")).select("doc_id")


@query(
    "q1_search_facets",
    f"""WITH {TERMS}, h AS (SELECT doc_id, lang, source FROM t WHERE list_contains(w, 'the')), p AS (SELECT doc_id FROM h ORDER BY doc_id LIMIT 5),
        f AS (SELECT 'lang' AS field, lang AS term, count(*) AS n FROM h GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM h GROUP BY source)
        SELECT field, term, n FROM f UNION ALL SELECT 'page', CAST(doc_id AS VARCHAR), 1 FROM p""",
)
def q1_search_facets(spark, d):
    found = search.parse_search("the")
    hits, counted = search.search_with_facets(table(spark, d, "documents"), "text", found, ["lang", "source"], order=[("doc_id", -1)], tie="doc_id", limit=5)
    page = hits.select(F.lit("page").alias("field"), F.col("doc_id").cast("string").alias("term"), F.lit(1).cast("bigint").alias("n"))
    return counted.unionByName(page)


@query("q1_indexed_search", _scored(["the", "and"], "list_contains(w, 'the') AND list_contains(w, 'and')", "ORDER BY round(s, 6) DESC, doc_id LIMIT 40"))
def q1_indexed_search(spark, d):
    stored = index.build_index(table(spark, d, "documents"), "doc_id", "text", work_folder(spark, "index"), buckets=16)
    found = index.indexed_search(spark, stored, search.parse_search("the and"), limit=40).hits
    return found.select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


@query(
    "q1_indexed_any_not",
    _scored(["le", "la"], "lang = 'fr' AND (list_contains(w, 'le') OR list_contains(w, 'la')) AND NOT list_contains(w, 'pour') AND n_chars > 200", ""),
)
def q1_indexed_any_not(spark, d):
    docs = table(spark, d, "documents")
    stored = index.build_index(docs, "doc_id", "text", work_folder(spark, "index"), buckets=16)
    allowed = docs.filter("lang = 'fr' and n_chars > 200").select(F.col("doc_id").alias("id"))
    found = index.indexed_search(spark, stored, search.parse_search("le|la -pour"), rows=allowed).hits
    return found.select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


@query("q2_count", f"WITH {TERMS} SELECT count(*) AS n FROM t WHERE list_contains(w, 'with') AND source = 'src7'")
def q2_count(spark, d):
    return search.search_count(table(spark, d, "documents"), "text", search.parse_search("with source:src7"))


@query(
    "a12_facets",
    """WITH f AS (SELECT 'lang' AS field, lang AS term, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source)
       SELECT field, term, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, term) AS r FROM f) WHERE r <= 5""",
)
def a12_facets(spark, d):
    return search.facets(table(spark, d, "documents").select("lang", "source"), ["lang", "source"], 5)


@query(
    "a12_term_facets",
    f"""WITH {TERMS}, f AS (SELECT term, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM t) GROUP BY term)
        SELECT 'terms' AS field, term, n FROM f ORDER BY n DESC, term LIMIT 25""",
)
def a12_term_facets(spark, d):
    docs = table(spark, d, "documents").select(tokens(F.col("text")).alias("terms"))
    return search.facets(docs, ["terms"], 25)


# graph: buyers, nations and orders ------------------------------------------------------------------------------------

ELEMENTS = """r AS (SELECT o_orderkey, o_orderdate, o_orderstatus, c_name, c_mktsegment, n_name, '/orders/' || o_orderstatus AS path
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  v AS (SELECT c_name AS name, 'buyer' AS type, path, o_orderdate AS time FROM r UNION ALL SELECT n_name, 'nation', path, o_orderdate FROM r),
  m AS (SELECT name, type, min(time) AS created, max(time) AS modified, count(*) AS seen, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM v GROUP BY name, type)"""


def _records(spark, d):
    customers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def _rules():
    vertex_rules = [
        VertexRule("buyer", F.col("c_name"), {"segment": F.col("c_mktsegment")}),
        VertexRule("nation", F.col("n_name")),
    ]
    return vertex_rules, [EdgeRule("lives_in", 0, 1, {"status": F.col("o_orderstatus")})]


def _path():
    return F.concat(F.lit("/orders/"), "o_orderstatus")


def _vertices(spark, d):
    return graph.vertices(_records(spark, d), _rules()[0], _path(), F.col("o_orderdate"))


@query("g1_decompose", f"WITH {ELEMENTS} SELECT name, type, path, count(*) AS n FROM v GROUP BY ALL")
def g1_decompose(spark, d):
    return _vertices(spark, d).groupBy("name", "type", "path").agg(F.count(F.lit(1)).alias("n"))


def _speaker_elements(frames):
    """User decomposition: one vertex per speaker and one edge from speaker to conversation, per turn."""
    for frame in frames:
        talk = "talk-" + frame["conv_id"].astype(str)
        yield pd.DataFrame({"kind": "vertex", "a": frame["role"], "b": ""})
        yield pd.DataFrame({"kind": "edge", "a": frame["role"], "b": talk})


@query(
    "g1_user_decompose",
    "SELECT 'vertex' AS kind, role AS a, '' AS b, count(*) AS n FROM conversations GROUP BY role UNION ALL SELECT 'edge', role, 'talk-' || conv_id, count(*) FROM conversations GROUP BY role, conv_id",
)
def g1_user_decompose(spark, d):
    elements = graph.decompose(table(spark, d, "conversations").select("conv_id", "role"), _speaker_elements, "kind string, a string, b string")
    return elements.groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g2_vertex_merge",
    f"""WITH {ELEMENTS} SELECT name, type, strftime(created, '%Y-%m-%d') AS created, strftime(modified, '%Y-%m-%d') AS modified, seen, paths FROM m""",
)
def g2_vertex_merge(spark, d):
    merged = graph.merge_elements(_vertices(spark, d))
    day = lambda name: F.date_format(name, "yyyy-MM-dd").alias(name)
    return merged.select("name", "type", day("created"), day("modified"), "seen", F.array_join("paths", ",").alias("paths"))


@query(
    "g2_stored_merge",
    f"""WITH {ELEMENTS} SELECT name, type, type = 'buyer' AS stored_id, CASE WHEN type = 'buyer' THEN '1990-01-01' ELSE strftime(created, '%Y-%m-%d') END AS created FROM m""",
)
def g2_stored_merge(spark, d):
    merged = graph.merge_elements(_vertices(spark, d))
    long_ago = F.lit("1990-01-01").cast("timestamp_ntz")
    people = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("buyer").alias("type"))
    places = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("type"))
    stored = people.union(places).select(
        "name", "type", F.concat(F.lit("s-"), "name").alias("id"), long_ago.alias("created"), long_ago.alias("modified"), F.concat(F.lit("/graph/"), "type").alias("__bucket")
    )
    both = graph.merge_into_stored(merged, stored, ["/graph/b*"])
    return both.select("name", "type", F.col("id").startswith("s-").alias("stored_id"), F.date_format("created", "yyyy-MM-dd").alias("created"))


class Widest(GroupReducer):
    """Keep the span and the number of elements of a key."""

    def reduce(self, rows: pd.DataFrame) -> pd.DataFrame:
        return self.merge(pd.DataFrame({"name": rows["name"], "type": rows["type"], "first": rows["day"], "last": rows["day"], "n": 1}))

    def merge(self, reduced: pd.DataFrame) -> pd.DataFrame:
        return reduced.groupby(["name", "type"], as_index=False, sort=False).agg(first=("first", "min"), last=("last", "max"), n=("n", "sum"))


@query(
    "g3_custom_merge",
    f"WITH {ELEMENTS} SELECT name, type, CAST(strftime(created, '%Y%m%d') AS BIGINT) AS first, CAST(strftime(modified, '%Y%m%d') AS BIGINT) AS last, seen AS n FROM m WHERE seen > 1",
)
def g3_custom_merge(spark, d):
    day = F.year("time") * 10000 + F.month("time") * 100 + F.dayofmonth("time")
    elements = _vertices(spark, d).select("name", "type", day.cast("bigint").alias("day"))
    schema = "name string, type string, first bigint, last bigint, n bigint"
    return graph.merge_custom(elements, Widest, schema, schema, finalize_all=False)


@query(
    "g4_edges",
    f"""WITH {ELEMENTS}, e AS (SELECT c_name, n_name, count(*) AS seen FROM r GROUP BY c_name, n_name)
        SELECT 'lives_in' AS label, md5('{{"name":"' || c_name || '","type":"buyer"}}') AS out_id, md5('{{"name":"' || n_name || '","type":"nation"}}') AS in_id, seen FROM e""",
)
def g4_edges(spark, d):
    records = _records(spark, d)
    vertex_rules, edge_rules = _rules()
    merged = graph.merge_elements(graph.vertices(records, vertex_rules, _path(), F.col("o_orderdate")))
    edges = graph.edges(records, vertex_rules, edge_rules, _path(), F.col("o_orderdate"))
    return graph.resolve_edges(edges, merged).select("label", "out_id", "in_id", "seen")
