"""Queries over the predicate algebra, sorting, limits and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from docsieve.functions import globs, paths
from docsieve.functions.text import tokens
from docsieve.operators import query as q
from docsieve.operators.buckets import coerce
from docsieve.operators.grouped import tag_inputs
from docsieve.operators.query import FieldMatcher, all_of, any_of
from docsieve.plans.registry import query, table

LINE = "l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag, l_linestatus"


def _lines(df: DataFrame) -> DataFrame:
    return df.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity", "l_returnflag", "l_linestatus"
    )


@query(
    "first_slice",
    """SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_returnflag IN ('A', 'R')
         AND l_linestatus <> 'O'
       ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber LIMIT 50""",
)
def first_slice(spark: SparkSession, d: str) -> DataFrame:
    document = {
        "and": [
            {"rangeIn": {"l_shipdate": [[dt.datetime(1998, 1, 1), False], [dt.datetime(1999, 1, 1), True]]}},
            {"withAny": {"l_returnflag": ["A", "R"]}},
            {"whenNot": {"l_linestatus": "O"}},
        ]
    }
    found = (
        q.from_document(document, limit=50)
        .order_by(("l_extendedprice", -1), ("l_orderkey", 1), ("l_partkey", 1), ("l_linenumber", 1))
        .only("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    )
    out = found.apply(table(spark, d, "lineitem"))
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


@query("b1_when", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def b1_when(spark, d):
    return all_of().when("c_mktsegment", "MACHINERY").only("c_custkey", "c_name").apply(table(spark, d, "customer"))


@query(
    "b1_when_array",
    r"""SELECT doc_id FROM documents
        WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the')""",
)
def b1_when_array(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("terms"))
    return all_of().when("terms", "the").only("doc_id").apply(docs)


@query(
    "b2_when_not",
    """SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE l.toxic IS DISTINCT FROM 1 AND d.lang <> 'en'""",
)
def b2_when_not(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return all_of().when_not("toxic", 1).when_not("lang", "en").only("doc_id", "lang").apply(joined)


@query("b3_with_any", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def b3_with_any(spark, d):
    return all_of().with_any("p_type", ["PROMO", "SMALL"]).only("p_partkey", "p_type").apply(table(spark, d, "part"))


@query("b3_with_any_table", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def b3_with_any_table(spark, d):
    return q.semi_any(table(spark, d, "documents"), "doc_id", table(spark, d, "labels").select("doc_id")).select("doc_id", "source")


@query(
    "b4_with_all",
    r"""SELECT doc_id FROM documents
        WHERE list_has_all(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['the', 'of', 'and'])""",
)
def b4_with_all(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("terms"))
    return all_of().with_all("terms", ["the", "of", "and"]).only("doc_id").apply(docs)


@query("b5_range_above", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def b5_range_above(spark, d):
    return all_of().range_above("o_totalprice", 300000.0, True).only("o_orderkey", "o_totalprice").apply(table(spark, d, "orders"))


@query("b6_range_below", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 50000")
def b6_range_below(spark, d):
    return q.from_document({"rangeBelow": {"o_totalprice": [50000.0, False]}}).only("o_orderkey", "o_totalprice").apply(table(spark, d, "orders"))


@query(
    "b7_range_in",
    """SELECT 'oo' AS kind, count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20
       UNION ALL SELECT 'co', count(*) FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20
       UNION ALL SELECT 'cc', count(*) FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20
       UNION ALL SELECT 'oc', count(*) FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20""",
)
def b7_range_in(spark, d):
    lines = table(spark, d, "lineitem").select("l_quantity")
    kinds = {"oo": (True, True), "co": (False, True), "cc": (False, False), "oc": (True, False)}
    tests = {name: all_of().range_in("l_quantity", 10.0, low, 20.0, high).column(lines.schema) for name, (low, high) in kinds.items()}
    # the four counts come from one pass
    counts = lines.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("n")) for name in kinds])).alias("r")).select("r.*")


@query("b8_with_present", "SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def b8_with_present(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return all_of().with_present("quality").only("doc_id").apply(joined)


@query("b9_with_not_present", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def b9_with_not_present(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return all_of().with_not_present("quality").only("doc_id").apply(joined)


@query("b10_all_of", f"SELECT {LINE} FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 45")
def b10_all_of(spark, d):
    found = all_of().when("l_returnflag", "R").when("l_linestatus", "F").range_above("l_quantity", 45.0)
    return _lines(found.apply(table(spark, d, "lineitem")))


@query("b11_any_of", f"SELECT {LINE} FROM lineitem WHERE l_quantity >= 49 OR l_discount > 0.09")
def b11_any_of(spark, d):
    return _lines(any_of().range_above("l_quantity", 49.0).range_above("l_discount", 0.09, True).apply(table(spark, d, "lineitem")))


@query(
    "b12_tree",
    f"""SELECT {LINE} FROM lineitem WHERE (l_returnflag = 'A' AND (l_quantity < 5 OR l_quantity > 45))
        OR (l_returnflag = 'N' AND l_linestatus = 'F' AND l_tax = 0)""",
)
def b12_tree(spark, d):
    tree = any_of(
        all_of(any_of().range_below("l_quantity", 5.0, True).range_above("l_quantity", 45.0, True)).when("l_returnflag", "A"),
        all_of().when("l_returnflag", "N").also(all_of().when("l_linestatus", "F").when("l_tax", 0.0)),
    )
    return _lines(tree.apply(table(spark, d, "lineitem")))


@query(
    "b13_nested",
    """SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 5000 AND o_orderstatus = 'F'""",
)
def b13_nested(spark, d):
    buyer = table(spark, d, "customer").select("c_custkey", F.struct("c_mktsegment", "c_acctbal").alias("buyer"))
    docs = table(spark, d, "orders").join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    inner = all_of().when("c_mktsegment", "FURNITURE").range_above("c_acctbal", 5000.0, True).limit(1)
    return all_of().nested("buyer", inner).when("o_orderstatus", "F").only("o_orderkey").apply(docs)


@query("b14_example", "SELECT p_partkey FROM part WHERE p_type = 'LARGE' AND p_size = 10")
def b14_example(spark, d):
    return q.by_example({"p_type": "LARGE", "p_size": 10, "p_brand": None}).only("p_partkey").apply(table(spark, d, "part"))


@query(
    "b15_document",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_orderstatus = 'O' OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice <= 100000)""",
)
def b15_document(spark, d):
    document = {
        "or": [
            {"when": {"o_orderstatus": "O"}},
            {"withAny": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "rangeBelow": {"o_totalprice": [100000.0, False]}},
        ],
        "when": {"o_orderstatus": "F"},
    }
    return q.from_document(document).only("o_orderkey", "o_orderpriority").apply(table(spark, d, "orders"))


@query(
    "b16_scoped",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 100000
       GROUP BY o_orderstatus""",
)
def b16_scoped(spark, d):
    mine = q.scoped(table(spark, d, "orders"), all_of().when_not("o_orderpriority", "5-LOW"))
    return all_of().range_above("o_totalprice", 100000.0, True).filter(mine).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("b17_pattern", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^red.*$') OR regexp_matches(p_name, '(?i)GEAR')")
def b17_pattern(spark, d):
    parts = table(spark, d, "part")
    test = F.col("p_name").rlike(globs.pattern_regex("RED*")) | F.col("p_name").rlike(globs.pattern_regex("/GEAR/i"))
    return parts.filter(test).select("p_partkey", "p_name")


@query("b18_threshold", "SELECT event_id, value FROM events WHERE COALESCE(value, 0) < 1 OR COALESCE(value, 0) > 200")
def b18_threshold(spark, d):
    return table(spark, d, "events").filter(q.outside_threshold(F.col("value"), 1.0, 200.0)).select("event_id", "value")


@query(
    "b19_level",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' ELSE 'DEBUG' END AS severity
       FROM events WHERE event_type = 'error' OR event_type = 'purchase'
          OR (event_type = 'view' AND user_id = 7)""",
)
def b19_level(spark, d):
    severity = (
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN")
        .when(F.col("event_type") == "signup", "INFO").when(F.col("event_type") == "click", "TRACE").otherwise("DEBUG")
    )
    events = table(spark, d, "events").withColumns({"severity": severity, "subsystem": F.concat(F.lit("user"), F.col("user_id"))})
    kept = events.filter(q.meets_level(F.col("severity"), F.col("subsystem"), "WARN", {"user7": "DEBUG"}) & (F.col("severity") != "INFO"))
    return kept.select("event_id", "severity")


@query(
    "b20_rules",
    "SELECT page_id FROM pages WHERE regexp_extract(url, '^https?://([^/]+)', 1) LIKE 'blog.%' OR regexp_extract(url, '^https?://([^/]+)', 1) NOT LIKE '%.example.com'",
)
def b20_rules(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    return pages.filter(globs.rule_list(F.col("host"), ["+blog.*", r"-/\.example\.com$/i"])).select("page_id")


@query("o1_order_by", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def o1_order_by(spark, d):
    found = all_of().order_by(("c_nationkey", 1)).order_by(("c_acctbal", -1), ("c_custkey", 1)).only("c_custkey", "c_nationkey", "c_acctbal")
    return found.apply(table(spark, d, "customer")).withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


@query("o3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o3_top_k(spark, d):
    return all_of().order_by(("o_totalprice", -1), ("o_orderkey", 1)).limit(100).only("o_orderkey", "o_totalprice").apply(table(spark, d, "orders"))


@query("o5_skip", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def o5_skip(spark, d):
    return all_of().order_by(("o_totalprice", 1), ("o_orderkey", 1)).skip(50).limit(25).only("o_orderkey", "o_totalprice").apply(table(spark, d, "orders"))


@query("p1_include", "SELECT c_custkey, c_mktsegment, nation_name FROM (SELECT c.*, n_name AS nation_name FROM customer c JOIN nation ON c_nationkey = n_nationkey)")
def p1_include(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("home"))
    docs = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return q.include_fields(docs, ["c_custkey", "c_mktsegment", "home.n_name"]).select("c_custkey", "c_mktsegment", F.col("home.n_name").alias("nation_name"))


@query("p2_exclude", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def p2_exclude(spark, d):
    return q.exclude_fields(table(spark, d, "customer"), ["c_nationkey"])


@query("p4_mutations", "SELECT o_orderkey, 'X' AS o_orderstatus, round(o_totalprice * 2, 2) AS doubled FROM orders")
def p4_mutations(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return q.with_mutations(orders, {"o_orderstatus": F.lit("X"), "doubled": F.round(F.col("o_totalprice") * 2, 2)}).drop("o_totalprice")


@query(
    "p5_fold",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, event_type, user_id, 'bigint string' AS kinds, true AS whole, 2 + 7 % 5 AS inner_n, false AS refused FROM events""",
)
def p5_fold(spark, d):
    events = table(spark, d, "events")
    # members of every kind: one replaced, the others as they were
    base = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "user_id": "old", "flag": true, "obj": {"n": 4, "t": "4"}}'))
    folded = paths.fold_into_json(base, {"event_type": (F.col("event_type"), "string"), "user_id": (F.col("user_id"), "bigint")})
    out = events.select("event_id", F.parse_json(folded).alias("m"), paths.not_an_object(base).alias("refused"))
    kind = lambda path: F.lower(F.schema_of_variant(F.variant_get("m", path, "variant")))
    return out.select(
        "event_id",
        F.variant_get("m", "$.k", "string").alias("k"),
        F.variant_get("m", "$.event_type", "string").alias("event_type"),
        F.variant_get("m", "$.user_id", "bigint").alias("user_id"),
        F.concat_ws(" ", kind("$.obj.n"), kind("$.obj.t")).alias("kinds"),
        F.variant_get("m", "$.flag", "boolean").alias("whole"),
        F.variant_get("m", "$.obj.n", "int").alias("inner_n"),
        "refused",
    )


@query("p6_columnar", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def p6_columnar(spark, d):
    return q.select_columns(table(spark, d, "orders"), FieldMatcher(types=("number",), globs=("*key",), exclude_types=("date",)))


@query("p7_type_override", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_retailprice FROM part")
def p7_type_override(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return q.override_types(parts, {"string": FieldMatcher(names=("p_size",)), "double": FieldMatcher(globs=("*price",))})


@query(
    "p9_table_format",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(round(value) AS BIGINT) AS value, TRY_CAST(event_type AS BIGINT) IS NULL AS bad_type FROM events",
)
def p9_table_format(spark, d):
    events = table(spark, d, "events").withColumn("value", F.round("value"))
    declared = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("value", T.LongType()), T.StructField("event_type", T.LongType())])
    return coerce(events, declared).select("event_id", "value", F.col("event_type").isNull().alias("bad_type"))


@query(
    "p10_markers",
    """SELECT 'orders' AS input, false AS injected, count(*) AS n FROM orders
       UNION ALL SELECT 'customer', false, count(*) FROM customer""",
)
def p10_markers(spark, d):
    both = tag_inputs({"orders": table(spark, d, "orders").select("o_custkey"), "customer": table(spark, d, "customer").select("c_custkey")})
    return both.groupBy(F.col("__input").alias("input"), F.col("__injected").alias("injected")).agg(F.count(F.lit(1)).alias("n"))
