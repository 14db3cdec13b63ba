"""Queries over bucket sets, glob and authorization joins, other joins, slices, retention and routing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docsieve.functions import globs, timefn
from docsieve.functions.ids import ReservedNames, permission
from docsieve.operators import buckets, query as q, routing, security, timeslice
from docsieve.operators.grouped import tag_inputs
from docsieve.operators.query import all_of
from docsieve.plans.registry import query, table


def _parties(spark, d):
    """Two buckets of people with different members."""
    return {
        "/parties/customer": table(spark, d, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
        ),
        "/parties/supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "/other/part": table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
    }


PARTIES = """parties AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, '/parties/customer' AS bucket FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, '/parties/supplier' FROM supplier)"""


@query("u1_union", f"WITH {PARTIES} SELECT id, name, balance, COALESCE(segment, '-') AS segment, bucket FROM parties")
def u1_union(spark, d):
    out = buckets.union_buckets(_parties(spark, d), ["/parties/*"])
    return out.fillna("-", ["segment"]).withColumnRenamed("__bucket", "bucket")


@query("u1_union_top", f"WITH {PARTIES} SELECT id, bucket, balance FROM parties ORDER BY balance DESC, bucket, id LIMIT 30")
def u1_union_top(spark, d):
    out = buckets.union_buckets(_parties(spark, d), ["/parties/**"]).withColumnRenamed("__bucket", "bucket")
    return all_of().order_by(("balance", -1), ("bucket", 1), ("id", 1)).limit(30).only("id", "bucket", "balance").apply(out)


@query("u2_first_hit", f"WITH {PARTIES} SELECT id, min(bucket) AS bucket FROM parties GROUP BY id")
def u2_first_hit(spark, d):
    return buckets.first_hit(buckets.union_buckets(_parties(spark, d), ["/parties/*"]), ["id"]).select("id", F.col("__bucket").alias("bucket"))


@query("u3_extra_predicate", f"WITH {PARTIES} SELECT id, bucket FROM parties WHERE (bucket = '/parties/customer' AND segment = 'BUILDING') OR (bucket = '/parties/supplier' AND balance > 5000)")
def u3_extra_predicate(spark, d):
    extra = {"/parties/customer": all_of().when("segment", "BUILDING"), "/parties/supplier": all_of().range_above("balance", 5000.0, True)}
    return buckets.union_buckets(_parties(spark, d), ["/parties/*"], extra.get).select("id", F.col("__bucket").alias("bucket"))


@query("s20_inputs", "SELECT 'doc' AS input, lang AS word, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'talk', role, count(*) FROM conversations GROUP BY role")
def s20_inputs(spark, d):
    both = tag_inputs({"doc": table(spark, d, "documents").select(F.col("lang").alias("word")), "talk": table(spark, d, "conversations").select(F.col("role").alias("word"))})
    return both.groupBy(F.col("__input").alias("input"), "word").agg(F.count(F.lit(1)).alias("n"))


PAGE_PATH = r"regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '')"


def _page_paths(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", path.alias("path"))


@query(
    "j1_glob_filter",
    f"""SELECT page_id, path FROM (SELECT page_id, {PAGE_PATH} AS path FROM pages) WHERE regexp_matches(path, '^/blog\\.[^/]*/en/.*$') OR regexp_matches(path, '^/[^/]*\\.example\\.com/fr/[^/]*$')""",
)
def j1_glob_filter(spark, d):
    return _page_paths(spark, d).filter(globs.matches_path(F.col("path"), ["/blog.*/en/**", "/*.example.com/fr/*"]))


def _page_patterns(spark, d):
    """One pattern per host and one per language of the pages."""
    paths = _page_paths(spark, d)
    host = F.regexp_extract("path", "^/([^/]+)", 1)
    lang = F.regexp_extract("path", "^/[^/]+/([^/]+)", 1)
    per_host = paths.select(F.concat(F.lit("/"), host, F.lit("/**")).alias("pattern"))
    per_lang = paths.select(F.concat(F.lit("/*/"), lang, F.lit("/*")).alias("pattern"))
    return per_host.union(per_lang).distinct()


@query(
    "j1_glob_join",
    f"""WITH p AS (SELECT page_id, {PAGE_PATH} AS path FROM pages),
        pat AS (SELECT DISTINCT '/' || regexp_extract(path, '^/([^/]+)', 1) || '/**' AS pattern FROM p
                UNION SELECT DISTINCT '/*/' || regexp_extract(path, '^/[^/]+/([^/]+)', 1) || '/*' FROM p)
        SELECT pattern, count(*) AS n FROM p JOIN pat ON CASE WHEN pattern LIKE '/*/%' THEN regexp_matches(path, '^/[^/]*/' || regexp_extract(pattern, '^/\\*/([^/]+)/', 1) || '/[^/]*$')
           ELSE starts_with(path, left(pattern, length(pattern) - 2)) END GROUP BY pattern""",
)
def j1_glob_join(spark, d):
    joined = buckets.glob_join(_page_paths(spark, d), "path", _page_patterns(spark, d), "pattern")
    return joined.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j1_glob_join_choices",
    f"""WITH p AS (SELECT page_id, {PAGE_PATH} AS path FROM pages)
        SELECT pattern, count(*) AS n FROM p, (VALUES ('/*/{{en,fr}}/*', '^/[^/]*/(en|fr)/[^/]*$'), ('/*/[de]*/**', '^/[^/]*/[de][^/]*/.*$'), ('/*/[!e]?/*', '^/[^/]*/[^e][^/]/[^/]*$'),
          ('/**', '^/.*$'), ('/*', '^/[^/]*$')) v(pattern, re) WHERE regexp_matches(path, re) GROUP BY pattern""",
)
def j1_glob_join_choices(spark, d):
    patterns = ["/*/{en,fr}/*", "/*/[de]*/**", "/*/[!e]?/*", "/**", "/*"]
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, patterns))).alias("pattern"))
    return buckets.glob_join(_page_paths(spark, d), "path", rows, "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j1_glob_join_runs",
    f"""WITH p AS (SELECT page_id, {PAGE_PATH} AS path FROM pages),
        pat AS (SELECT DISTINCT '/' || substr(path, 2, 2) || '*' || right(path, 1) || '/**' AS pattern, '^/' || regexp_escape(substr(path, 2, 2)) || '[^/]*' || regexp_escape(right(path, 1)) || '/.*$' AS re FROM p
                UNION SELECT DISTINCT '/**' || right(path, 3), '^/.*' || regexp_escape(right(path, 3)) || '$' FROM p
                UNION SELECT DISTINCT '/*' || substr(path, 4, 1) || '*/*/*', '^/[^/]*' || regexp_escape(substr(path, 4, 1)) || '[^/]*/[^/]*/[^/]*$' FROM p
                UNION ALL VALUES ('/*/*/*', '^/[^/]*/[^/]*/[^/]*$'), ('/**', '^/.*$'))
        SELECT pattern, count(*) AS n FROM p JOIN pat ON regexp_matches(path, re) GROUP BY pattern""",
)
def j1_glob_join_runs(spark, d):
    # patterns with neither a literal folder nor a literal part, made from the paths themselves
    paths = _page_paths(spark, d)
    start = F.concat(F.lit("/"), F.substring("path", 2, 2), F.lit("*"), F.right("path", F.lit(1)), F.lit("/**"))
    end = F.concat(F.lit("/**"), F.right("path", F.lit(3)))
    middle = F.concat(F.lit("/*"), F.substring("path", 4, 1), F.lit("*/*/*"))
    made = paths.select(F.explode(F.array(start, end, middle, F.lit("/*/*/*"), F.lit("/**"))).alias("pattern")).distinct()
    return buckets.glob_join(paths, "path", made, "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u4_expansion",
    f"""SELECT DISTINCT path FROM (SELECT {PAGE_PATH} AS path FROM pages) WHERE regexp_matches(path, '^/[^/]+/.*$')""",
)
def u4_expansion(spark, d):
    return buckets.expand_patterns(_page_paths(spark, d).select("path"), "path", _page_patterns(spark, d), "pattern").select("path")


GRANTS = """grants AS (SELECT DISTINCT role AS principal, 'Bucket:read:docs:' || CASE role WHEN 'user' THEN 'en:*' WHEN 'assistant' THEN 'fr:src3' ELSE '*' END AS permission FROM conversations)"""


def _grants(spark, d):
    role = F.col("role")
    tail = F.when(role == "user", "en:*").when(role == "assistant", "fr:src3").otherwise("*")
    return table(spark, d, "conversations").select(role.alias("principal"), F.concat(F.lit("Bucket:read:docs:"), tail).alias("permission")).distinct()


def _doc_path():
    return F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source")


@query("j2_authorized", "SELECT doc_id FROM documents WHERE lang = 'en'")
def j2_authorized(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return security.authorized(docs, permission("Bucket", "read", _doc_path()), _grants(spark, d), "user").select("doc_id")


@query("y1_secured_read", "SELECT doc_id FROM documents WHERE (lang = 'fr' AND source IN ('src1', 'src2')) OR lang = 'de'")
def y1_secured_read(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _doc_path().alias("path"))
    held = ["Bucket:read:docs:fr:src1", "Bucket:*:docs:fr:src2", "Bucket:read:docs:de:*"]
    return security.readable_rows(docs, "path", held).select("doc_id")


@query("y2_secured_buckets", "SELECT DISTINCT '/docs/' || lang || '/' || source AS path FROM documents WHERE lang = 'en' AND regexp_matches(source, '^src1[^/]*$')")
def y2_secured_buckets(spark, d):
    catalog = table(spark, d, "documents").select(_doc_path().alias("path")).distinct()
    allowed = security.authorized(catalog, permission("Bucket", "read", F.col("path")), _grants(spark, d), "user")
    return allowed.filter(globs.matches_path(F.col("path"), ["/docs/*/src1*"])).select("path")


@query(
    "y4_auths",
    """SELECT doc_id, CASE WHEN source = 'src1' OR lang = 'fr' THEN source ELSE '-' END AS source, n_chars FROM documents WHERE lang IN ('fr', 'en')""",
)
def y4_auths(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "source", "n_chars", F.array("lang").alias("d_auth"), F.create_map(F.lit("source"), F.array("source", "lang")).alias("f_auth")
    )
    seen = security.doc_level(docs, "d_auth", ["fr", "en"])
    masked = security.field_level_by_row(seen, "f_auth", ["source", "n_chars"], ["src1", "fr"])
    return masked.select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), "n_chars")


@query(
    "j4_self_join",
    """SELECT a.conv_id, a.turn, CAST(length(a.text) AS BIGINT) AS asked, CAST(length(b.text) AS BIGINT) AS answered
       FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def j4_self_join(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    a, b = turns.alias("a"), turns.alias("b")
    joined = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return joined.select("a.conv_id", "a.turn", F.col("a.size").alias("asked"), F.col("b.size").alias("answered"))


# routing --------------------------------------------------------------------------------------------------------------


@query("e1_route_field", "SELECT doc_id, '/docs/' || source AS target FROM documents WHERE lang <> 'en'")
def e1_route_field(spark, d):
    target = F.when(F.col("lang") == "en", "$private").otherwise(F.concat(F.lit("/docs/"), "source"))
    docs = table(spark, d, "documents").select("doc_id", F.struct(target.alias("field")).alias("object_field"))
    return routing.route(docs, "$object_field.field").select("doc_id", F.col("__target").alias("target"))


@query(
    "e1_route_modes",
    """SELECT 'internal' AS output, '-' AS target, count(*) AS n FROM pages UNION ALL SELECT 'default', '-', count(*) FROM pages
       UNION ALL SELECT 'path', '/archive', count(*) FROM pages""",
)
def e1_route_modes(spark, d):
    pages = table(spark, d, "pages").select("page_id")
    out = None
    for name, output in {"internal": routing.INTERNAL, "default": None, "stop": routing.STOP, "path": "/archive"}.items():
        part = routing.route(pages, output).withColumn("output", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("output", F.coalesce("__target", F.lit("-")).alias("target")).agg(F.count(F.lit(1)).alias("n"))


ROUTED = """routed AS (SELECT doc_id, CASE WHEN lang = 'en' THEN NULL WHEN lang = 'fr' THEN '/out/fr/' || source WHEN lang = 'de' THEN '/own/' || source ELSE '/closed/x' END AS target FROM documents)"""


def _emission(spark, d):
    target = (
        F.when(F.col("lang") == "en", F.lit(None)).when(F.col("lang") == "fr", F.concat(F.lit("/out/fr/"), "source"))
        .when(F.col("lang") == "de", F.concat(F.lit("/own/"), "source")).otherwise("/closed/x")
    )
    routed = table(spark, d, "documents").select("doc_id", target.alias(routing.TARGET))
    return routing.emit_allowed(routed, ["/out/**"], sub_buckets=["/own/src1", "/own/src2"], writable=F.col(routing.TARGET) != "/out/fr/src3")


@query("k11_external", f"WITH {ROUTED} SELECT doc_id, target FROM routed WHERE (target LIKE '/out/%' AND target <> '/out/fr/src3') OR target IN ('/own/src1', '/own/src2')")
def k11_external(spark, d):
    return _emission(spark, d).external.select("doc_id", F.col("__target").alias("target"))


@query(
    "e2_errors",
    f"""WITH {ROUTED} SELECT doc_id, CASE WHEN target LIKE '/out/%' THEN 'target not writable' ELSE 'target not in the allow-list' END AS reason
        FROM routed WHERE target IS NOT NULL AND NOT ((target LIKE '/out/%' AND target <> '/out/fr/src3') OR target IN ('/own/src1', '/own/src2'))""",
)
def e2_errors(spark, d):
    return _emission(spark, d).errors.select("doc_id", F.col("__reason").alias("reason"))


@query("k13_sub_buckets", f"WITH {ROUTED} SELECT target, count(*) AS n FROM routed WHERE target IN ('/own/src1', '/own/src2') GROUP BY target")
def k13_sub_buckets(spark, d):
    sub = _emission(spark, d).external.filter(F.col("__target").startswith("/own/"))
    return sub.groupBy(F.col("__target").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p8_log_rows",
    """SELECT value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, event_type AS message, 'user' AS generated_by, '/logs/' || user_id AS bucket, 'events' AS subsystem,
         'ingest' AS command, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, 'host' AS hostname FROM events""",
)
def p8_log_rows(spark, d):
    return _log_rows(table(spark, d, "events"))


def _log_rows(events):
    return routing.log_rows(
        events, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type"), "user", F.concat(F.lit("/logs/"), "user_id"), F.lit("events"), F.lit("ingest"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), "host", ["value"],
    )


@query("e4_log_filter", "SELECT '/_logging/buckets/logs/' || user_id AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id")
def e4_log_filter(spark, d):
    rows = _log_rows(table(spark, d, "events"))
    kept = rows.filter(q.meets_level(F.col("severity"), F.col("subsystem"), "WARN"))
    return kept.groupBy(ReservedNames().to_log(F.col("bucket")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# slices and retention ----------------------------------------------------------------------------------------------------

NOW = dt.datetime(2024, 1, 25)
DIRS = """dirs AS (SELECT DISTINCT CASE event_type WHEN 'click' THEN '/data/a_' || strftime(ts, '%Y.%m.%d') WHEN 'view' THEN '/data/b_' || strftime(ts, '%Y.%m.%d.%H') || '_10'
  WHEN 'error' THEN '/data/errors_' || user_id ELSE '/data/c_' || strftime(ts, '%Y.%m') || '/' END AS path,
  CASE event_type WHEN 'click' THEN date_trunc('day', ts) WHEN 'view' THEN date_trunc('hour', ts) WHEN 'error' THEN NULL ELSE date_trunc('month', ts) END::TIMESTAMP AS s,
  CASE event_type WHEN 'click' THEN date_trunc('day', ts) + INTERVAL 1 DAY WHEN 'view' THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 'error' THEN NULL ELSE date_trunc('month', ts) + INTERVAL 1 MONTH END::TIMESTAMP AS e FROM events)"""


def _directories(spark, d):
    kind, ts = F.col("event_type"), F.col("ts")
    path = (
        F.when(kind == "click", F.concat(F.lit("/data/a_"), timefn.dated_suffix(ts, "day")))
        .when(kind == "view", F.concat(F.lit("/data/b_"), timefn.dated_suffix(ts, "hour"), F.lit("_10")))
        .when(kind == "error", F.concat(F.lit("/data/errors_"), "user_id"))
        .otherwise(F.concat(F.lit("/data/c_"), timefn.dated_suffix(ts, "month"), F.lit("/")))
    )
    return table(spark, d, "events").select(path.alias("path")).distinct()


@query("s5_untimed", f"WITH {DIRS} SELECT path FROM dirs WHERE s IS NULL")
def s5_untimed(spark, d):
    return timeslice.untimed_directories(_directories(spark, d))


@query("t4_spans", f"WITH {DIRS} SELECT path, strftime(s, '%Y-%m-%d %H') AS s, strftime(e, '%Y-%m-%d %H') AS e FROM dirs WHERE s IS NOT NULL")
def t4_spans(spark, d):
    spans = timeslice.timed_directories(_directories(spark, d))
    return spans.select("path", F.date_format("start", "yyyy-MM-dd HH").alias("s"), F.date_format("end", "yyyy-MM-dd HH").alias("e"))


@query("s4_pruned", f"WITH {DIRS} SELECT path FROM dirs WHERE TIMESTAMP '2024-01-15' < e AND TIMESTAMP '2024-01-20' >= s")
def s4_pruned(spark, d):
    return timeslice.prune_directories(_directories(spark, d), *timeslice.time_range("10 days", "5 days", NOW))


@query("u5_directory_sets", f"WITH {DIRS} SELECT s IS NOT NULL AS timed, count(*) AS n FROM dirs GROUP BY 1")
def u5_directory_sets(spark, d):
    spans = timeslice.annotate_directories(_directories(spark, d))
    return spans.groupBy(F.col("start").isNotNull().alias("timed")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s12_coarse_and_exact",
    """SELECT 'coarse' AS kind, count(*) AS n FROM events WHERE strftime(ts, '%Y.%m.%d') BETWEEN '2024.01.10' AND '2024.01.20'
       UNION ALL SELECT 'exact', count(*) FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-20 06:00:00'""",
)
def s12_coarse_and_exact(spark, d):
    sliced = timeslice.with_slice(table(spark, d, "events").select("ts"), "ts", "day", "record")
    low, high = dt.datetime(2024, 1, 10, 12), dt.datetime(2024, 1, 20, 6)
    counts = [
        timeslice.sliced_scan(sliced, "ts", "day", low, high, exact).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
        for name, exact in (("coarse", False), ("exact", True))
    ]
    return counts[0].unionByName(counts[1])


@query(
    "k5_batch_slices",
    """WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id)
       SELECT strftime(first, '%Y.%m.%d') AS slice, count(*) AS n FROM events JOIN f USING (user_id) GROUP BY 1""",
)
def k5_batch_slices(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id")
    sliced = timeslice.with_slice(events, "ts", "day", "batch", batch=["user_id"], order=["ts", "event_id"])
    return sliced.groupBy(F.col("__slice").alias("slice")).agg(F.count(F.lit(1)).alias("n"))


@query("r1_age_out", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY event_type")
def r1_age_out(spark, d):
    sliced = timeslice.with_slice(table(spark, d, "events"), "ts", "week", "record")
    kept = timeslice.age_out(sliced, "ts", "2 weeks", NOW, period="week")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("r1_expired", f"WITH {DIRS} SELECT path FROM dirs WHERE e <= TIMESTAMP '2024-01-11'")
def r1_expired(spark, d):
    return timeslice.expired_slices(_directories(spark, d), "2 weeks", NOW).select("path")


@query(
    "r3_tiers",
    """SELECT CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'hot' WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'warm'
         WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'cold' ELSE 'expired' END AS tier, count(*) AS n FROM orders GROUP BY 1""",
)
def r3_tiers(spark, d):
    named = timeslice.tier(F.col("o_orderdate"), dt.datetime(2001, 1, 1), {"hot": "1 year", "warm": "3 years", "cold": "5 years"})
    return table(spark, d, "orders").groupBy(named.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r4_needs_age_out",
    "SELECT source AS bucket FROM documents GROUP BY source HAVING max(CASE WHEN lang = 'es' THEN n_chars END) IS NOT NULL OR max(CASE WHEN n_chars > 15000 THEN 1 END) IS NOT NULL",
)
def r4_needs_age_out(spark, d):
    catalog = table(spark, d, "documents").groupBy(F.col("source").alias("bucket")).agg(
        F.max(F.when(F.col("lang") == "es", F.col("n_chars"))).alias("temporal_age"), F.max(F.when(F.col("n_chars") > 15000, 1)).alias("raw_age")
    )
    return timeslice.age_out_needed(["temporal_age", "raw_age"]).filter(catalog).select("bucket")
