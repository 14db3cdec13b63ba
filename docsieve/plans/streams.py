"""Queries over streams run to completion; each result is what the same batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions.timefn import millis
from docsieve.operators.dedup import DedupConfig
from docsieve.operators.query import all_of
from docsieve.plans.enrichment import Step, run_steps
from docsieve.plans.merges import throttle_sql
from docsieve.plans.registry import query, table, work_folder
from docsieve.sources import bucketed, readers
from docsieve.sources.layout import Bucket, parse_address
from docsieve.sources.versioned import current_folder
from docsieve.sources.writers import to_messages
from docsieve.streaming import batches, cuts, keyed, stateful
from docsieve.streaming.stored import dedup_into, dedup_into_buckets


def _events_stream(spark, d):
    schema = table(spark, d, "events").schema
    return readers.stream_folder(spark, d, schema, pathGlobFilter="events.parquet")


@query("s13_new_data_only", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def s13_new_data_only(spark, d):
    folder = work_folder(spark, "served")
    events = table(spark, d, "events")
    for arriving in (events.filter(F.col("event_type") == "click"), events.filter(~F.col("event_type").eqNullSafe("click")), None):
        if arriving is not None:  # the last run finds nothing new
            arriving.write.mode("append").parquet(f"{folder}/in")
        stream = readers.stream_folder(spark, f"{folder}/in", events.schema)
        batches.emit_to_folder(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("k9_emit", "SELECT event_id, event_type, 'bucket' AS side FROM events UNION ALL SELECT event_id, event_type, 'message' FROM events")
def k9_emit(spark, d):
    folder = work_folder(spark, "emitted")
    handle = batches.emit_to_bucket_and_messages(f"{folder}/bucket", f"{folder}/messages")
    stream = _events_stream(spark, d).select("event_id", "event_type")
    batches.run_batches(stream, handle, f"{folder}/checkpoint").awaitTermination()
    kept = spark.read.parquet(f"{folder}/bucket").select("event_id", "event_type", F.lit("bucket").alias("side"))
    messages = spark.read.text(f"{folder}/messages").select(F.from_json("value", "event_id bigint, event_type string").alias("r"))
    return kept.unionByName(messages.select("r.event_id", "r.event_type", F.lit("message").alias("side")))


@query(
    "s8_addresses",
    """SELECT address, count(*) AS n FROM events JOIN (VALUES ('/feed', 'click'), ('/feed:', 'view'), ('/feed:clean', 'purchase'), ('mine', 'signup')) v(address, kind)
         ON event_type = kind GROUP BY address""",
)
def s8_addresses(spark, d):
    # each kind of event is sent to one place, and read back by the address of that place
    own = Bucket("/own", work_folder(spark, "addressed"))
    events = table(spark, d, "events").select("event_id", "event_type")
    out = None
    for address, kind in (("/feed", "click"), ("/feed:", "view"), ("/feed:clean", "purchase"), ("mine", "signup")):
        bucket, stage = parse_address(address, own)
        to_messages(events.filter(F.col("event_type") == kind)).write.text(bucket.topic(stage))
        seen = f"{own.folder}/seen/{stage}"
        batches.emit_to_folder(readers.stream_address(spark, address, own, events.schema), seen, f"{seen}-checkpoint").awaitTermination()
        part = spark.read.schema(events.schema).parquet(seen).select(F.lit(address).alias("address"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("address").agg(F.count(F.lit(1)).alias("n"))


@query("z3_cut_by_count", "SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // 700 AS BIGINT) AS batch, event_id FROM events")
def z3_cut_by_count(spark, d):
    events = table(spark, d, "events").select("event_id")
    return batches.cut_by_count(events, ["event_id"], 700, chunks=8).select(F.col("__batch").alias("batch"), "event_id")


@query(
    "z4_cut_by_size",
    """WITH s AS (SELECT event_id, strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS size FROM events),
       r AS (SELECT event_id, sum(size) OVER (ORDER BY event_id) - size AS before FROM s)
       SELECT CAST(before // 16384 AS BIGINT) AS batch, event_id FROM r""",
)
def z4_cut_by_size(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return batches.cut_by_size(events, ["event_id"], 16, chunks=8).select(F.col("__batch").alias("batch"), "event_id")


def _cut_stream(spark, d, columns, **limit):
    """Batch and id of all events, read as a stream of one file after the other, each file a third of the ids in order."""
    folder = work_folder(spark, "cut")
    events = table(spark, d, "events").select(*columns)
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = ((high or 0) - (low or 0)) // 3 + 1
    for nth in range(3):  # one run of the stream a third, so that each is a micro-batch of its own and they come in order
        events.filter(F.floor((F.col("event_id") - F.lit(low)) / step) == nth).write.mode("append").parquet(f"{folder}/in")
        stream = readers.stream_folder(spark, f"{folder}/in", events.schema)
        handle = cuts.cut_into(f"{folder}/out", ["event_id"], **limit)
        batches.run_batches(stream, handle, f"{folder}/checkpoint").awaitTermination()
    return cuts.full_batches(spark, f"{folder}/out", with_open=True, **limit).select(F.col("__batch").alias("batch"), "event_id")


@query("z3_stream_count", "SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // 700 AS BIGINT) AS batch, event_id FROM events")
def z3_stream_count(spark, d):
    return _cut_stream(spark, d, ["event_id"], rows=700)


@query(
    "z4_stream_size",
    """WITH s AS (SELECT event_id, strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS size FROM events),
       r AS (SELECT event_id, sum(size) OVER (ORDER BY event_id) - size AS before FROM s)
       SELECT CAST(before // 16384 AS BIGINT) AS batch, event_id FROM r""",
)
def z4_stream_size(spark, d):
    return _cut_stream(spark, d, ["event_id", "event_type"], kilobytes=16)


def _batched(spark, d, files, max_files, every):
    """Events in ``files`` files as micro-batches of at most ``max_files`` files; (event_type, rows, batches)."""
    folder = work_folder(spark, "batched")
    events = table(spark, d, "events").select("event_id", "event_type")
    events.repartition(files, "event_id").write.parquet(f"{folder}/in")
    stream = readers.stream_folder(spark, f"{folder}/in", events.schema, max_files=max_files)

    def keep(df, batch_id):
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/number={batch_id}")

    running = batches.run_batches(stream, keep, f"{folder}/checkpoint", every=every)
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batch").alias("batches"))


@query("z2_by_time", "SELECT event_type, count(*) AS n, CAST(3 AS BIGINT) AS batches FROM events GROUP BY event_type")
def z2_by_time(spark, d):
    return _batched(spark, d, 3, 1, "200 milliseconds")


@query("z5_batch_controls", "SELECT event_type, count(*) AS n, CAST(2 AS BIGINT) AS batches FROM events GROUP BY event_type")
def z5_batch_controls(spark, d):
    return _batched(spark, d, 4, 2, "0 seconds")


@query("z6_stream_steps", "SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 20")
def z6_stream_steps(spark, d):
    folder = work_folder(spark, "steps")
    steps = [
        Step("valued", lambda df: all_of().range_above("value", 20.0, True).filter(df)),
        Step("named", lambda df: df.select("event_id", F.upper("event_type").alias("kind"))),
    ]
    out = run_steps({"events": _events_stream(spark, d)}, steps)["named"]
    batches.emit_to_folder(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("z7_stream_dedup", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY user_id")
def z7_stream_dedup(spark, d):
    folder = work_folder(spark, "store")
    events = table(spark, d, "events").select(F.concat(F.lit("e-"), "event_id").alias("_id"), "user_id", "ts", "event_id")
    events.repartition(3, "event_id").write.parquet(f"{folder}/in")
    config = DedupConfig(order=("ts", "event_id"), policy="update", fields=("user_id",), timestamp="ts")
    stream = readers.stream_folder(spark, f"{folder}/in", events.schema, max_files=1)
    batches.run_batches(stream, dedup_into(f"{folder}/store", config), f"{folder}/checkpoint").awaitTermination()
    stored = spark.read.parquet(current_folder(spark, f"{folder}/store"))
    return stored.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query(
    "z7_touched_buckets",
    """SELECT user_id, CASE WHEN user_id = (SELECT max(user_id) FROM events) THEN '2100-01-01 00:00:00' ELSE strftime(max(ts), '%Y-%m-%d %H:%M:%S') END AS last,
         CAST(1 AS BIGINT) AS rewritten FROM events GROUP BY user_id""",
)
def z7_touched_buckets(spark, d):
    # all events, then a late one of a single user: of eight buckets, one is written again
    folder = work_folder(spark, "buckets")
    events = table(spark, d, "events").select(F.concat(F.lit("e-"), "event_id").alias("_id"), "user_id", "ts", "event_id")
    late = events.agg(F.max("user_id").alias("user_id")).select(
        F.lit("late").alias("_id"), "user_id", F.lit("2100-01-01").cast(events.schema["ts"].dataType).alias("ts"), F.lit(0).cast("bigint").alias("event_id")
    )
    config = DedupConfig(order=("ts", "event_id"), policy="update", fields=("user_id",), timestamp="ts")
    for arriving in (events, late):
        before = {} if arriving is events else bucketed.manifest(spark, f"{folder}/store").folders
        arriving.write.mode("append").parquet(f"{folder}/in")
        stream = readers.stream_folder(spark, f"{folder}/in", events.schema)
        batches.run_batches(stream, dedup_into_buckets(f"{folder}/store", config, 8), f"{folder}/checkpoint").awaitTermination()
    after = bucketed.manifest(spark, f"{folder}/store").folders
    rewritten = sum(1 for number in before | after if before.get(number) != after.get(number))
    last = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last")
    return bucketed.read(spark, f"{folder}/store").select("user_id", last, F.lit(rewritten).cast("bigint").alias("rewritten"))


@query(
    "z8_stream_merge",
    """SELECT user_id, event_id, n AS merge_count, round(s, 2) AS merge_sum FROM (SELECT user_id, event_id, count(*) OVER w AS n, sum(COALESCE(value, 0)) OVER w AS s
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n % 5 = 0""",
)
def z8_stream_merge(spark, d):
    merged = _merged_stream(spark, d, stateful.Rules(every_nth=5))
    return merged.select("user_id", "event_id", "merge_count", F.round("merge_sum", 2).alias("merge_sum"))


def _merged_stream(spark, d, rules):
    """Rows of the running merge of events per user that pass the rules, from a stream run to its end."""
    folder = work_folder(spark, "merged")
    stream = _events_stream(spark, d).withColumn("at", millis(F.col("ts")))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, stateful.ROCKSDB)
    try:
        merged = stateful.running_merge_stream(stream, "user_id", "at", "value", "event_id", rules)
        batches.emit_to_folder(merged, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{folder}/out")


@query(
    "z8_stream_threshold",
    """SELECT event_id, n AS merge_count, least(prev, value) AS pair_min FROM (SELECT event_id, value, count(*) OVER w AS n,
         last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE value < 5 OR value > 150""",
)
def z8_stream_threshold(spark, d):
    return _merged_stream(spark, d, stateful.Rules(below=5.0, above=150.0)).select("event_id", "merge_count", "pair_min")


@query("z8_stream_throttle", throttle_sql("user_id", 86_400_000, "false"))
def z8_stream_throttle(spark, d):
    return _merged_stream(spark, d, stateful.Rules(every_ms=86_400_000)).select("event_id")


HOT = "CASE WHEN event_type = 'error' THEN user_id ELSE -1 END"


def _hot_stream(spark, d, rules):
    """Rows that the rules let through, keyed so that one key holds most events, from three micro-batches in order of time."""
    folder = work_folder(spark, "hot")
    events = table(spark, d, "events").select("event_id", "value", millis(F.col("ts")).alias("at"), F.expr(HOT).alias("k"))
    low, high = events.agg(F.min("at"), F.max("at")).first()
    step = ((high or 0) - (low or 0)) // 3 + 1

    def keep(df, number):
        df.write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    for nth in range(3):
        events.filter(F.floor((F.col("at") - F.lit(low)) / step) == nth).write.mode("append").parquet(f"{folder}/in")
        stream = readers.stream_folder(spark, f"{folder}/in", events.schema)
        handle = keyed.merge_into(f"{folder}/state", ["k"], "at", "value", "event_id", keep, rules, chunks=8, buckets=8)
        batches.run_batches(stream, handle, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(
    "z8_hot_key",
    f"""SELECT event_id, n AS merge_count, round(s, 2) AS merge_sum, least(prev, value) AS pair_min FROM (SELECT event_id, value, count(*) OVER w AS n, sum(COALESCE(value, 0)) OVER w AS s,
         last_value(value IGNORE NULLS) OVER (PARTITION BY {HOT} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
         FROM events WINDOW w AS (PARTITION BY {HOT} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n % 5 = 0 OR value > 150""",
)
def z8_hot_key(spark, d):
    merged = _hot_stream(spark, d, stateful.Rules(every_nth=5, above=150.0))
    return merged.select("event_id", "merge_count", F.round("merge_sum", 2).alias("merge_sum"), "pair_min")


@query("z8_hot_throttle", throttle_sql(HOT, 3_600_000, "value > 150"))
def z8_hot_throttle(spark, d):
    return _hot_stream(spark, d, stateful.Rules(every_ms=3_600_000, above=150.0)).select("event_id")


@query("z9_consumers", "SELECT name, count(*) AS n FROM events, (VALUES ('first'), ('second')) v(name) GROUP BY name")
def z9_consumers(spark, d):
    folder = work_folder(spark, "consumers")
    out = None
    for name in ("first", "second"):
        stream = _events_stream(spark, d).select("event_id")
        batches.emit_to_folder(stream, f"{folder}/{name}", f"{folder}/checkpoint-{name}").awaitTermination()
        part = spark.read.parquet(f"{folder}/{name}").withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
