"""Queries over keyed merges, running merges, emission rules, counts and change rules on the event stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docsieve.operators import buckets, diff, merge as mg, query as q
from docsieve.operators.query import all_of
from docsieve.plans.registry import query, table

ORDER = ["ts", "event_id"]
RUN = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def events(spark, d, *columns):
    return table(spark, d, "events").select(*columns) if columns else table(spark, d, "events")


@query("a1_count", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def a1_count(spark, d):
    return q.count_by(table(spark, d, "lineitem"), all_of().when("l_returnflag", "R"))


@query("a3_exists", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 400000")
def a3_exists(spark, d):
    return q.exists_by(table(spark, d, "orders"), all_of().range_above("o_totalprice", 400000.0, True))


@query(
    "a4_group_rows",
    """WITH numbered AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)
       SELECT lang, source, CAST((n - 1) // 10 AS BIGINT) AS page, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS items
       FROM numbered GROUP BY lang, source, (n - 1) // 10""",
)
def a4_group_rows(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", "doc_id")
    pages = diff.group_pages(docs, ["lang", "source"], ["doc_id"], F.col("doc_id").cast("string"), page_rows=10)
    return pages.withColumn("items", F.array_join("items", ","))


@query("a5_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def a5_latest(spark, d):
    last = mg.merge(events(spark, d, "user_id", *ORDER, "event_type"), ["user_id"], {"r": mg.latest(F.struct("event_type", "event_id"), ORDER)})
    return last.select("user_id", "r.event_type", "r.event_id")


@query(
    "a6_append",
    "SELECT conv_id, string_agg(text, ' ' ORDER BY turn DESC) AS message FROM conversations GROUP BY conv_id",
)
def a6_append(spark, d):
    return mg.merge_append(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "text", ["turn"])


@query(
    "a11_chain",
    """SELECT event_type, count(*) AS merge_count, round(sum(COALESCE(value, 0)), 2) AS merge_sum, min(value) AS merge_min, max(value) AS merge_max,
         arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY event_type""",
)
def a11_chain(spark, d):
    merged = mg.merge(
        events(spark, d, "event_type", "value", *ORDER),
        ["event_type"],
        {
            "merge_count": mg.merge_count(),
            "merge_sum": mg.merge_sum(F.col("value")),
            "merge_min": mg.merge_min(F.col("value")),
            "merge_max": mg.merge_max(F.col("value")),
            "last_event": mg.latest(F.col("event_id"), ORDER),
        },
    )
    return merged.withColumn("merge_sum", F.round("merge_sum", 2))


@query("a7_merge_count", "SELECT user_id, event_type, count(*) AS merge_count FROM events GROUP BY user_id, event_type")
def a7_merge_count(spark, d):
    return mg.merge(events(spark, d, "user_id", "event_type"), ["user_id", "event_type"], {"merge_count": mg.merge_count()})


@query("a8_merge_sum", "SELECT user_id, round(sum(CASE WHEN event_type = 'error' THEN 0 ELSE value END), 2) AS lost FROM events GROUP BY user_id")
def a8_merge_sum(spark, d):
    value = F.when(F.col("event_type") != "error", F.col("value"))
    merged = mg.merge(events(spark, d, "user_id", "event_type", "value"), ["user_id"], {"lost": mg.merge_sum(value)})
    return merged.withColumn("lost", F.round("lost", 2))


@query("a9_min_max", "SELECT l_suppkey, min(l_extendedprice) AS merge_min, max(l_extendedprice) AS merge_max FROM lineitem GROUP BY l_suppkey")
def a9_min_max(spark, d):
    price = F.col("l_extendedprice")
    return mg.merge(table(spark, d, "lineitem"), ["l_suppkey"], {"merge_min": mg.merge_min(price), "merge_max": mg.merge_max(price)})


@query("a13_objects_per_bucket", "SELECT '/docs/' || lang || '/' || source AS bucket, count(*) AS n FROM documents GROUP BY 1")
def a13_objects_per_bucket(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source").alias(buckets.BUCKET))
    return buckets.count_across(docs).withColumnRenamed(buckets.BUCKET, "bucket")


@query(
    "a10_overlay",
    """WITH e AS (SELECT user_id, ts, event_id, event_type AS member, value FROM events
                  UNION ALL SELECT user_id, ts, event_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)
       SELECT user_id, member, arg_max(value, (ts, event_id)) AS value FROM e GROUP BY user_id, member""",
)
def a10_overlay(spark, d):
    rows = events(spark, d).withColumn(
        "details", F.create_map(F.col("event_type"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    )
    overlaid = mg.merge_overlay(rows, ["user_id"], "details", ORDER)
    return overlaid.select("user_id", F.explode("details").alias("member", "value"))


@query("a2_count_across", "SELECT '/orders/' || o_orderstatus AS bucket, count(*) AS n FROM orders GROUP BY 1")
def a2_count_across(spark, d):
    orders = table(spark, d, "orders").select(F.concat(F.lit("/orders/"), "o_orderstatus").alias("__bucket"))
    return buckets.count_across(orders).withColumnRenamed("__bucket", "bucket")


@query(
    "a14_change_threshold",
    """WITH c AS (SELECT source, count(*) AS current, count(l.doc_id) AS last FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)
       SELECT source AS resource, current, last FROM c WHERE last > 0 AND current - last > 30""",
)
def a14_change_threshold(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    current = diff.resource_sizes(docs, "source")
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    last = diff.resource_sizes(labelled, "source").withColumnRenamed("current", "last")
    return diff.changed_beyond(current, last, 30)


RULE = {
    "op": "and",
    "rules": [
        {"op": "or", "rules": [{"resource": "purchase"}, {"resource": "signup"}]},
        {"op": "not", "rules": [{"resource": "error"}, {"resource": "view", "enabled": False}]},
        {"resource": "click", "enabled": False},
    ],
}


@query(
    "a15_rule_tree",
    """SELECT user_id, day, (bool_or(event_type = 'purchase') OR bool_or(event_type = 'signup')) AND NOT bool_or(event_type = 'error') AS satisfied
       FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events) GROUP BY user_id, day""",
)
def a15_rule_tree(spark, d):
    fired = events(spark, d).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return diff.satisfied(fired, ["user_id", "day"], "event_type", RULE)


@query(
    "w1_w2_running",
    f"SELECT event_id, count(*) OVER {RUN} AS merge_count, round(sum(COALESCE(value, 0)) OVER {RUN}, 2) AS merge_sum FROM events",
)
def w1_w2_running(spark, d):
    out = mg.running_merge(events(spark, d, "user_id", "value", *ORDER), ["user_id"], ORDER, F.col("value"))
    return out.select("event_id", "merge_count", F.round("merge_sum", 2).alias("merge_sum"))


@query(
    "w1_w2_hot_keys",
    """SELECT event_id, count(*) OVER w AS merge_count, round(sum(COALESCE(value, 0)) OVER w, 2) AS merge_sum,
         min(value) OVER w AS running_min, max(value) OVER w AS running_max
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def w1_w2_hot_keys(spark, d):
    out = mg.running_merge(events(spark, d, "event_type", "value", *ORDER), ["event_type"], ORDER, F.col("value"), chunks=16)
    return out.select("event_id", "merge_count", F.round("merge_sum", 2).alias("merge_sum"), "running_min", "running_max")


W3 = """WITH v AS (SELECT event_id, {key} AS k, ts, CASE WHEN value > 100 THEN NULL ELSE value END AS v FROM events),
  p AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v)
  SELECT event_id, least(prev, v) AS pair_min, greatest(prev, v) AS pair_max FROM p WHERE prev IS NOT NULL OR v IS NOT NULL"""


def _pairs(spark, d, key, chunks=None):
    value = F.when(F.col("value") <= 100, F.col("value"))
    out = mg.running_merge(events(spark, d, key, "value", *ORDER), [key], ORDER, value, chunks)
    return out.filter(F.col("pair_min").isNotNull()).select("event_id", "pair_min", "pair_max")


@query("w3_pairwise", W3.format(key="user_id"))
def w3_pairwise(spark, d):
    return _pairs(spark, d, "user_id")


@query("w3_pairwise_hot_keys", W3.format(key="event_type"))
def w3_pairwise_hot_keys(spark, d):
    return _pairs(spark, d, "event_type", chunks=16)


@query(
    "w4_every_nth",
    "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 5 = 0",
)
def w4_every_nth(spark, d):
    return mg.every_nth(events(spark, d, "user_id", *ORDER), ["user_id"], ORDER, 5).select("event_id", "user_id")


@query(
    "w6_outside",
    f"""SELECT event_id, round(s, 2) AS merge_sum FROM (SELECT event_id, sum(COALESCE(value, 0)) OVER {RUN} AS s FROM events) WHERE round(s, 2) < 50 OR round(s, 2) > 2000""",
)
def w6_outside(spark, d):
    merged = mg.running_merge(events(spark, d, "user_id", "value", *ORDER), ["user_id"], ORDER, F.col("value"))
    merged = merged.withColumn("merge_sum", F.round("merge_sum", 2))
    return mg.emit_any(merged, [mg.rule_outside(F.col("merge_sum"), 50.0, 2000.0)]).select("event_id", "merge_sum")


def throttle_sql(key: str, period: int, forced: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT event_id, {key} AS k, epoch_us(ts) // 1000 AS ms, {forced} AS force,
        row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
      walk AS (SELECT event_id, k, ms AS mark, n, true AS hit FROM e WHERE n = 1
        UNION ALL SELECT e.event_id, e.k, CASE WHEN e.force OR e.ms - walk.mark > {period} THEN e.ms ELSE walk.mark END, e.n,
          e.force OR e.ms - walk.mark > {period} FROM walk JOIN e ON e.k = walk.k AND e.n = walk.n + 1)
      SELECT event_id FROM walk WHERE hit"""


@query("w5_throttle", throttle_sql("user_id", 86_400_000, "false"))
def w5_throttle(spark, d):
    return mg.throttle(events(spark, d, "user_id", *ORDER), ["user_id"], ORDER, 86_400_000).select("event_id")


@query("w5_throttle_hot_keys", throttle_sql("event_type", 3_600_000, "false"))
def w5_throttle_hot_keys(spark, d):
    rows = events(spark, d, "event_type", *ORDER)
    return mg.throttle(rows, ["event_type"], ORDER, 3_600_000, chunks=16).select("event_id")


@query("w7_any_rule", throttle_sql("user_id", 172_800_000, "(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) % 7 = 0 OR value > 150"))
def w7_any_rule(spark, d):
    merged = mg.running_merge(events(spark, d, "user_id", "value", *ORDER), ["user_id"], ORDER)
    forced = mg.rule_every_nth(7) | mg.rule_outside(F.col("value"), high=150.0)
    return mg.throttle(merged, ["user_id"], ORDER, 172_800_000, forced).select("event_id")


def _numbered(kind: pd.Series, count: pd.Series) -> pd.Series:
    return kind + " #" + count.astype(str)


@query(
    "w8_formatter",
    f"SELECT event_id, event_type || ' #' || c AS message FROM (SELECT event_id, event_type, count(*) OVER {RUN} AS c FROM events) WHERE c % 3 = 0",
)
def w8_formatter(spark, d):
    merged = mg.running_merge(events(spark, d, "user_id", "event_type", *ORDER), ["user_id"], ORDER)
    kept = mg.emit_any(merged, [mg.rule_every_nth(3)])
    return mg.formatted(kept, "message", _numbered, "string", ["event_type", "merge_count"]).select("event_id", "message")


def _halved(row: dict) -> dict:
    """Emitted rows carry half of the sum and count themselves as an arrival, which moves every later emission."""
    return {**row, "merge_sum": row["merge_sum"] / 2, "merge_count": row["merge_count"] + 1}


FEEDBACK = """WITH RECURSIVE e AS (SELECT event_id, event_type AS k, COALESCE(value, 0) AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n
    FROM events),
  walk AS (SELECT event_id, k, n, CAST(1 AS BIGINT) AS c, CAST(v AS DOUBLE) AS s, false AS hit FROM e WHERE n = 1
    UNION ALL SELECT e.event_id, e.k, e.n, CASE WHEN (c + 1) % 3 = 0 THEN c + 2 ELSE c + 1 END, CASE WHEN (c + 1) % 3 = 0 THEN (s + e.v) / 2 ELSE s + e.v END,
      (c + 1) % 3 = 0 FROM walk JOIN e ON e.k = walk.k AND e.n = walk.n + 1)
  SELECT event_id, k AS event_type, c AS merge_count, round(s, 4) AS merge_sum FROM walk WHERE hit"""


@query("w8_feedback", FEEDBACK)
def w8_feedback(spark, d):
    # micro-seconds stand for the time: the order is that of the timestamps
    rows = table(spark, d, "events").select("event_type", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = mg.merged_with_feedback(rows, ["event_type"], "at", "event_id", "value", mg.Rules(every_nth=3), _halved, chunks=8)
    return out.select("event_id", "event_type", "merge_count", F.round("merge_sum", 4).alias("merge_sum"))
