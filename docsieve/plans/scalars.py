"""Queries over scalar functions: paths, time, globs, identifiers, tokens."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from docsieve.functions import globs, ids, paths, timefn
from docsieve.functions.text import tokens
from docsieve.plans.registry import query, table

NOW = dt.datetime(2024, 1, 15)


@query(
    "x1_property",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS deep, true AS missing FROM events""",
)
def x1_property(spark, d):
    events = table(spark, d, "events")
    listed = F.concat(F.lit('{"a": {"aa": [{"v": '), "props", F.lit("}, {}], \"b\": false}}"))
    docs = events.select("event_id", F.try_parse_json("props").alias("flat"), F.try_parse_json(listed).alias("nested"))
    return docs.select(
        "event_id",
        paths.json_value_at(F.col("flat"), "k", "bigint").alias("k"),
        paths.json_value_at(F.col("nested"), "a.aa.v.k", "bigint").alias("deep"),
        paths.json_value_at(F.col("nested"), "a.b.c").isNull().alias("missing"),
    )


@query("x1_property_struct", "SELECT conv_id, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def x1_property_struct(spark, d):
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.struct(F.array(F.min_by(F.struct("role", "turn"), "turn")).alias("turns")).alias("talk"))
    return talks.select("conv_id", paths.value_at(talks.schema, "talk.turns.role").alias("role"))


@query(
    "x2_json_types",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, json_extract_string(props, '$.k') AS text, event_type AS word FROM events",
)
def x2_json_types(spark, d):
    number = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select(
        "event_id",
        paths.json_typed(number, "double").alias("number"),
        paths.json_typed(F.concat(F.lit('"'), number, F.lit('"')), "string").alias("text"),
        F.get(paths.json_typed(F.to_json(F.array("event_type")), "array<string>"), F.lit(0)).alias("word"),
    )


@query("x3_scalar_key", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def x3_scalar_key(spark, d):
    docs = table(spark, d, "documents").select("lang", F.array("lang").alias("langs"))
    keyed = docs.select(paths.key_value_at(docs.schema, "lang").alias("lang"), paths.key_value_at(docs.schema, "langs").alias("none"))
    return keyed.filter(F.col("none").isNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x4_timestamps",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_text, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS from_number, event_type = 'none' AS from_word FROM events""",
)
def x4_timestamps(spark, d):
    ts = F.col("ts")
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(F.col("event_type") == "view", "Z").otherwise(""))
    shown = lambda column: F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select(
        "event_id",
        shown(timefn.flexible_timestamp(iso, "string")).alias("from_text"),
        shown(timefn.flexible_timestamp(timefn.millis(ts), "bigint")).alias("from_number"),
        timefn.flexible_timestamp(F.col("event_type"), "string").isNotNull().alias("from_word"),
    )


@query(
    "x5_periods",
    """SELECT CASE event_type WHEN 'click' THEN 'hour' WHEN 'view' THEN 'day' WHEN 'error' THEN '-' ELSE 'month' END AS period, count(*) AS n FROM events GROUP BY 1""",
)
def x5_periods(spark, d):
    word = F.when(F.col("event_type") == "click", "Hourly").when(F.col("event_type") == "view", "1 D").when(F.col("event_type") == "error", "m").otherwise("month")
    period = F.coalesce(timefn.period_column(word), F.lit("-"))
    return table(spark, d, "events").groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("x6_duration", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS due FROM orders")
def x6_duration(spark, d):
    due = F.col("o_orderdate") + timefn.span_of("3 months").column()
    return table(spark, d, "orders").select("o_orderkey", F.date_format(due, "yyyy-MM-dd").alias("due"))


@query(
    "x7_schedule",
    "SELECT CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'before' WHEN ts < TIMESTAMP '2024-01-22' THEN 'within' ELSE 'after' END AS phase, count(*) AS n FROM events GROUP BY 1",
)
def x7_schedule(spark, d):
    bound = lambda text: F.lit(timefn.moment_of(text, NOW).isoformat(sep=" ")).cast("timestamp_ntz")
    phase = F.when(F.col("ts") < bound("10 days ago"), "before").when(F.col("ts") < bound("1 week"), "within").otherwise("after")
    return table(spark, d, "events").groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x8_reflected",
    """SELECT event_id, strftime(CASE WHEN ts > TIMESTAMP '2024-01-15' THEN TIMESTAMP '2024-01-15' - (ts - TIMESTAMP '2024-01-15') ELSE ts END, '%Y-%m-%d') AS day FROM events""",
)
def x8_reflected(spark, d):
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", F.date_format(timefn.past_reflected_column(F.col("ts"), now), "yyyy-MM-dd").alias("day"))


@query("x9_glob", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '(?i)^brand#1.$')")
def x9_glob(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand").rlike(globs.pattern_regex("BRAND#1?"))).select("p_partkey")


@query("x10_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)(bolt|gear)')")
def x10_regex(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").rlike(globs.pattern_regex("/(BOLT|GEAR)/i"))).select("p_partkey")


@query("x11_path_glob", "SELECT doc_id FROM documents WHERE regexp_matches('/docs/' || lang || '/' || source, '^/docs/[^/]*/src1[^/]$')")
def x11_path_glob(spark, d):
    path = F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source")
    return table(spark, d, "documents").filter(globs.matches_path(path, ["/docs/*/src1?"])).select("doc_id")


def _signature_sql(path: str, sub: str) -> str:
    return f"""regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN len(parts) = 1 THEN left(parts[1], 16)
        WHEN len(parts) = 2 THEN left(parts[1], 16) || '_' || left(parts[2], 16)
        ELSE left(parts[1], 16) || '_' || left(parts[-2], 16) || '_' || left(parts[-1], 16) END {sub}), '[^a-z0-9_]', '_', 'g'), '__+', '_', 'g'), '_$', '')
        || '__' || substr(md5({path}), 21, 12)"""


@query(
    "x13_signature",
    f"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?:/', '') AS path FROM pages),
        s AS (SELECT *, string_split(regexp_replace(regexp_replace(path, '^/', ''), '/+$', ''), '/') AS parts FROM p)
        SELECT page_id, {_signature_sql('path', '')} AS signature, {_signature_sql('path', "|| '_' || 'html+text'")} AS sub_signature FROM s""",
)
def x13_signature(spark, d):
    path = F.regexp_replace("url", "^https?:/", "")
    return table(spark, d, "pages").select(
        "page_id", ids.bucket_signature(path).alias("signature"), ids.bucket_signature(path, F.lit("html+text")).alias("sub_signature")
    )


@query(
    "x14_content_uuid",
    """WITH m AS (SELECT doc_id, md5(text) AS h FROM documents)
       SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (('0x' || substr(h, 17, 1))::INT % 4), 1)
         || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM m""",
)
def x14_content_uuid(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.name_uuid(F.col("text")).alias("uuid"))


@query("x15_random_uuid", "SELECT CAST(36 AS BIGINT) AS size, '4' AS version, count(*) AS n FROM events")
def x15_random_uuid(spark, d):
    made = table(spark, d, "events").select("event_id", ids.random_uuid().alias("uuid"))
    shape = made.groupBy(F.length("uuid").cast("bigint").alias("size"), F.substring("uuid", 15, 1).alias("version"))
    return shape.agg(F.count(F.lit(1)).alias("n"))


@query("x16_unique_time_uuid", "SELECT epoch_us(ts) // 1000 AS millis, count(*) AS ids, '1' AS version FROM events GROUP BY 1")
def x16_unique_time_uuid(spark, d):
    made = table(spark, d, "events").select(ids.unique_time_uuid(timefn.millis(F.col("ts")), F.col("event_id")).alias("uuid"))
    millis = ids.time_uuid_millis(F.col("uuid")).alias("millis")
    return made.groupBy(millis, F.substring("uuid", 15, 1).alias("version")).agg(F.count_distinct("uuid").alias("ids"))


@query("x16_time_uuid", "SELECT event_id, epoch_us(ts) // 1000 AS millis, '1' AS version FROM events")
def x16_time_uuid(spark, d):
    made = table(spark, d, "events").select("event_id", ids.time_uuid(timefn.millis(F.col("ts"))).alias("uuid"))
    return made.select("event_id", ids.time_uuid_millis(F.col("uuid")).alias("millis"), F.substring("uuid", 15, 1).alias("version"))


@query("x17_permission", "SELECT doc_id, 'Bucket:' || CASE WHEN lang = 'en' THEN 'read' ELSE '*' END || ':' || lang || ':' || source AS permission FROM documents")
def x17_permission(spark, d):
    action = F.when(F.col("lang") == "en", "read")
    path = F.concat(F.lit("/"), "lang", F.lit("/"), "source")
    return table(spark, d, "documents").select("doc_id", ids.permission("Bucket", action, path).alias("permission"))


@query(
    "x18_address",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN '/own' ELSE '/talk/' || conv_id END AS bucket,
         CASE role WHEN 'user' THEN '$start' WHEN 'assistant' THEN 'reply' ELSE 'system' END AS stage FROM conversations""",
)
def x18_address(spark, d):
    bucket = F.concat(F.lit("/talk/"), "conv_id")
    address = F.when(F.col("role") == "user", F.concat(bucket, F.lit(":"))).when(F.col("role") == "assistant", F.concat(bucket, F.lit(":reply"))).otherwise(F.col("role"))
    parsed = table(spark, d, "conversations").select("conv_id", "turn", ids.stage_address(address, "/own").alias("a"))
    return parsed.select("conv_id", "turn", "a.bucket", "a.stage")


@query(
    "x19_reserved",
    """SELECT doc_id, '/_testing/' || lang || '/docs/' || source AS test_path, '/_logging/buckets/docs/' || source AS log_path, true AS is_test, false AS is_external FROM documents""",
)
def x19_reserved(spark, d):
    names = ids.ReservedNames()
    path = F.concat(F.lit("/docs/"), "source")
    test = names.to_test(path, F.col("lang"))
    return table(spark, d, "documents").select(
        "doc_id", test.alias("test_path"), names.to_log(path).alias("log_path"), names.is_test(test).alias("is_test"), names.is_external(path).alias("is_external")
    )


@query(
    "x22_tokens",
    r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)""",
)
def x22_tokens(spark, d):
    split = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return split.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(
    "t1_coarsened",
    "SELECT strftime(ts, '%Y.%m.%d') AS suffix, count(*) AS n FROM events GROUP BY 1",
)
def t1_coarsened(spark, d):
    suffix = timefn.dated_suffix(F.col("ts"), "second", lowest="day")
    return table(spark, d, "events").groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


WEEK = """(WITH w AS (SELECT {day}::DATE AS d), s AS (SELECT d - dayofweek(d)::INT AS sunday FROM w), y AS (SELECT sunday, year(sunday + 6) AS yr FROM s),
  f AS (SELECT sunday, yr, make_date(yr, 1, 1) - dayofweek(make_date(yr, 1, 1))::INT AS first FROM y)
  SELECT lpad(yr::VARCHAR, 4, '0') || '-' || lpad(((sunday - first) // 7 + 1)::VARCHAR, 2, '0') FROM f)"""


@query(
    "t2_suffixes",
    f"""SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d.%H:%M:%S') AS second, strftime(o_orderdate, '%Y.%m.%d.%H') AS hour, strftime(o_orderdate, '%Y.%m') AS month,
          strftime(o_orderdate, '%Y') AS year, {WEEK.format(day='o_orderdate')} AS week FROM orders""",
)
def t2_suffixes(spark, d):
    names = ("second", "hour", "month", "year", "week")
    return table(spark, d, "orders").select("o_orderkey", *[timefn.dated_suffix(F.col("o_orderdate"), name).alias(name) for name in names])


@query(
    "t3_round_trip",
    """SELECT o_orderkey, 'month' AS period, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(o_orderdate::DATE - dayofweek(o_orderdate)::INT, '%Y-%m-%d') AS week, true AS bad FROM orders""",
)
def t3_round_trip(spark, d):
    shown = lambda suffix: F.date_format(timefn.suffix_start(suffix), "yyyy-MM-dd")
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        timefn.suffix_period(timefn.dated_suffix(day, "month")).alias("period"),
        shown(timefn.dated_suffix(day, "month")).alias("month"),
        shown(timefn.dated_suffix(day, "week")).alias("week"),
        shown(F.col("o_orderpriority")).isNull().alias("bad"),
    )


