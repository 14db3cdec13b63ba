"""Queries over scans and sinks: what is written is read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from docsieve.operators import buckets, paging, query as q, routing
from docsieve.operators.dedup import DedupConfig, dedup
from docsieve.operators.query import all_of
from docsieve.operators.update import Update
from docsieve.plans.registry import query, table, work_folder
from docsieve.session import written
from docsieve.sources import layout, readers, service, versioned, writers
from docsieve.sources.layout import Bucket, state_bucket
from docsieve.sources.readers import Input

NOW = dt.datetime(2001, 6, 1)


def _bucket(spark, name, **other) -> Bucket:
    return Bucket(f"/{name}", work_folder(spark, name), **other)


def _table_input(d: str, name: str, **other) -> Input:
    return Input(name, Bucket(f"/{name}", d), service="parquet", options={"path": f"{d}/{name}.parquet"}, **other)


@query("s1_stage_scan", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def s1_stage_scan(spark, d):
    bucket = _bucket(spark, "orders")
    writers.write_stage(table(spark, d, "orders"), bucket, "processed")
    stored = readers.scan_stage(spark, bucket)
    return stored.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("u1_bucket_set_scan", "SELECT '/set/' || p AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT 'a' AS p, o_totalprice FROM orders UNION ALL SELECT 'b', s_acctbal FROM supplier) GROUP BY p")
def u1_bucket_set_scan(spark, d):
    root = work_folder(spark, "set")
    stored = [Bucket("/set/a", root), Bucket("/set/b", root), Bucket("/other/c", root)]
    writers.write_stage(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), stored[0], "processed")
    supplier = table(spark, d, "supplier").select(F.col("s_acctbal").alias("o_totalprice"), "s_name")
    writers.write_stage(supplier, stored[1], "processed", preserve_existing=False)
    writers.write_stage(supplier, stored[2], "processed")
    found = readers.scan_bucket_set(spark, stored, ["/set/*"])
    return found.groupBy(F.col("__bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s2_import_folder", "SELECT event_type, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY event_type")
def s2_import_folder(spark, d):
    bucket = _bucket(spark, "events")
    events = table(spark, d, "events").select("event_id", "event_type")
    events.write.json(f"{bucket.ready}/drop")
    dropped = readers.scan_ready(spark, bucket, "json", events.schema)
    return dropped.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("s3_transient_output", "SELECT lang, count(*) AS n FROM documents WHERE n_chars > 100 GROUP BY lang")
def s3_transient_output(spark, d):
    bucket = _bucket(spark, "docs")
    writers.write_stage(table(spark, d, "documents").filter("n_chars > 100").select("doc_id", "lang"), bucket, "transient_output", preserve_existing=False, job="first")
    return readers.scan_stage(spark, bucket, "transient_output", "first").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def _sliced_orders(spark, d) -> Bucket:
    bucket = _bucket(spark, "sliced", time_field="o_orderdate", slice_period="year")
    writers.write_sliced(table(spark, d, "orders"), bucket, policy="record", files_per_slice=2)
    return bucket


@query(
    "s4_sliced_scan",
    "SELECT strftime(o_orderdate, '%Y') AS slice, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y') BETWEEN '1998' AND '2000' GROUP BY 1",
)
def s4_sliced_scan(spark, d):
    scan = Input("orders", _sliced_orders(spark, d), time_min="3 years", time_max="1 year")
    return readers.scan_input(spark, scan, NOW).groupBy(F.col("__slice").alias("slice")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_sliced_scan_exact", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-06-01' AND TIMESTAMP '2000-06-01'")
def s4_sliced_scan_exact(spark, d):
    scan = Input("orders", _sliced_orders(spark, d), time_min="3 years", time_max="1 year", exact_times=True)
    return readers.scan_input(spark, scan, NOW).select("o_orderkey")


@query("s6_binary_files", "SELECT lang, sum(strlen(text) + 1)::BIGINT AS bytes, sum(strlen(text) + 1)::BIGINT AS content_bytes, true AS named FROM documents GROUP BY lang")
def s6_binary_files(spark, d):
    # every text and a line end, as files of bytes in a folder per language
    folder = work_folder(spark, "binary")
    table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(folder)
    files = readers.scan_binary(spark, folder, "*.txt").withColumn("lang", F.regexp_extract("path", "/lang=([^/]+)/", 1))
    return files.groupBy("lang").agg(
        F.sum("length").alias("bytes"), F.sum(F.octet_length("content")).cast("bigint").alias("content_bytes"), F.bool_and(F.col("path").endswith(".txt")).alias("named")
    )


@query("s7_file_listing", "SELECT strftime(o_orderdate, '%Y') AS slice, true AS has_files, true AS has_bytes FROM orders GROUP BY 1")
def s7_file_listing(spark, d):
    files = readers.scan_binary(spark, _sliced_orders(spark, d).stage(), "*.parquet", with_content=False)
    slices = files.groupBy(F.regexp_extract("path", "__slice=([^/]+)/", 1).alias("slice"))
    return slices.agg((F.count(F.lit(1)) > 0).alias("has_files"), (F.sum("length") > 0).alias("has_bytes"))


@query("k4_batched_write", "SELECT count(*) AS n, true AS compressed, true AS capped FROM orders")
def k4_batched_write(spark, d):
    bucket = _bucket(spark, "batched")
    settings = writers.WriteSettings(batch_max_objects=1000, target_write_concurrency=4, codec="gz")
    writers.write_stage(table(spark, d, "orders"), bucket, "processed", settings=settings)
    files = readers.scan_stage(spark, bucket).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("n"), F.every(F.col("file").contains(".gz.")).alias("compressed"), (F.max("n") <= 1000).alias("capped"))


@query("r1_stage_age_out", "SELECT strftime(o_orderdate, '%Y') AS slice, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1")
def r1_stage_age_out(spark, d):
    bucket = _sliced_orders(spark, d)
    writers.age_out_stage(spark, bucket, "processed", "3 years", NOW)
    return readers.scan_stage(spark, bucket).groupBy(F.col("__slice").alias("slice")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r1_graceful_age_out",
    """SELECT strftime(o_orderdate, '%Y') AS slice, count(*) AS n, o_orderdate >= TIMESTAMP '1998-01-01' AS shown,
       o_orderdate >= TIMESTAMP '1998-01-01' AS there_later FROM orders GROUP BY ALL""",
)
def r1_graceful_age_out(spark, d):
    """All slices on disk after the first run, whether scans show them, and whether the run after the grace left them."""
    bucket = _sliced_orders(spark, d)
    writers.age_out_stage(spark, bucket, "processed", "3 years", NOW, grace="1 hour")
    shown = readers.scan_stage(spark, bucket).select("__slice").distinct().withColumn("shown", F.lit(True))
    everything = spark.read.parquet(versioned.current_folder(spark, bucket.stage("processed"))).groupBy(F.col("__slice").cast("string").alias("__slice"))
    before = written(everything.agg(F.count(F.lit(1)).alias("n")).join(shown, "__slice", "left"), "before")
    writers.age_out_stage(spark, bucket, "processed", "3 years", NOW + dt.timedelta(hours=2), grace="1 hour")
    after = spark.read.parquet(versioned.current_folder(spark, bucket.stage("processed"))).select(F.col("__slice").cast("string").alias("__slice"))
    both = before.join(after.distinct().withColumn("there_later", F.lit(True)), "__slice", "left")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return both.select(F.col("__slice").alias("slice"), "n", flag("shown"), flag("there_later"))


@query("s10_service", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def s10_service(spark, d):
    return readers.scan_service(spark, "parquet", path=f"{d}/customer.parquet").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("s10_native_reader", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey > 1000 AND o_orderpriority <> '5-LOW' GROUP BY o_orderstatus")
def s10_native_reader(spark, d):
    service.register(spark, "docsieve_parts", service.ParquetParts)
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    orders = service.scan(spark, "docsieve_parts", columns, path=f"{d}/orders.parquet")
    wanted = orders.filter((F.col("o_orderkey") > 1000) & (F.col("o_orderpriority") != "5-LOW"))
    return wanted.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("s11_input_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def s11_input_filter(spark, d):
    wanted = all_of().when("o_orderstatus", "P").range_above("o_totalprice", 200000.0, True)
    return readers.scan_input(spark, _table_input(d, "orders", filter=wanted), NOW).select("o_orderkey")


@query("s14_record_limit", "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem LIMIT 500)")
def s14_record_limit(spark, d):
    return readers.scan_input(spark, _table_input(d, "lineitem", record_limit=500), NOW).agg(F.count(F.lit(1)).alias("n"))


@query("s15_get_one", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def s15_get_one(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return q.first_by_id(orders, "o_orderkey", orders.agg(F.max("o_orderkey").alias("k")).scalar())


@query("s16_get_many", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 1000 ORDER BY s_acctbal, s_suppkey LIMIT 20")
def s16_get_many(spark, d):
    spec = all_of().range_above("s_acctbal", 1000.0).order_by(("s_acctbal", 1), ("s_suppkey", 1)).limit(20)
    return spec.only("s_suppkey", "s_name").apply(table(spark, d, "supplier"))


@query(
    "s16_cursor_pages",
    """WITH e AS (SELECT event_id, event_type, CAST(nullif(floor(value), 3) AS BIGINT) AS level FROM events),
       r AS (SELECT event_id, level, row_number() OVER (ORDER BY level NULLS FIRST, event_type, event_id) AS nth FROM e WHERE event_type IN ('click', 'purchase', 'view'))
       SELECT (nth - 1) // 150 AS page, nth - 1 AS place, event_id, level FROM r WHERE nth <= 900""",
)
def s16_cursor_pages(spark, d):
    # six pages of 150 rows over three buckets, each asked for with nothing but the cursor of the page before
    events = table(spark, d, "events").withColumn("level", F.nullif(F.floor("value"), F.lit(3)))
    kinds = {f"/events/{kind}": events.filter(F.col("event_type") == kind).select("event_id", "level") for kind in ("click", "purchase", "view")}
    order, cursor, folder = [("level", 1)], None, work_folder(spark, "pages")
    for number in range(6):
        rows = paging.page(kinds, order, 150, "event_id", cursor)
        place = F.row_number().over(Window.orderBy(F.col("level").asc_nulls_first(), buckets.BUCKET, "event_id")) - 1
        rows.withColumn("place", place + number * 150).write.parquet(f"{folder}/page={number}")
        last = paging.last_row(spark.read.parquet(f"{folder}/page={number}"), order, "event_id")
        if last is None:
            break
        cursor = paging.cursor_of(last, order, "event_id")
    pages = spark.read.option("basePath", folder).parquet(folder)
    return pages.select(F.col("page").cast("bigint").alias("page"), F.col("place").cast("bigint").alias("place"), "event_id", "level")


@query("s17_table_view", "SELECT c_nationkey::BIGINT AS nation, count(*) AS n FROM customer GROUP BY c_nationkey")
def s17_table_view(spark, d):
    view = buckets.table_view(table(spark, d, "customer"), "/parties/customer")
    return spark.sql(f"SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS n FROM {view} GROUP BY c_nationkey")


@query("s18_warehouse_view", "SELECT o_orderpriority, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority")
def s18_warehouse_view(spark, d):
    sql = "SELECT o_orderpriority, max(o_totalprice) AS top FROM warehouse_orders GROUP BY o_orderpriority"
    return readers.warehouse_view(table(spark, d, "orders"), "warehouse_orders", sql, "warehouse_top")


@query(
    "s20_scan_inputs",
    "SELECT 'orders' AS input, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'part', count(*) FROM part",
)
def s20_scan_inputs(spark, d):
    inputs = [
        _table_input(d, "orders", filter=all_of().when("o_orderstatus", "F")),
        _table_input(d, "part"),
        _table_input(d, "lineitem", enabled=False),
    ]
    return readers.scan_inputs(spark, inputs, NOW).groupBy(F.col("__input").alias("input")).agg(F.count(F.lit(1)).alias("n"))


@query("k1_fan_out", "SELECT 'columnar' AS view, count(*) AS n FROM part UNION ALL SELECT 'document', count(*) FROM part")
def k1_fan_out(spark, d):
    folder = work_folder(spark, "fan")
    columnar = lambda df: df.write.parquet(f"{folder}/columnar")
    document = lambda df: df.write.json(f"{folder}/document")
    routing.fan_out(table(spark, d, "part"), {"columnar": columnar, "document": document, "search": columnar})
    stored = {"columnar": spark.read.parquet(f"{folder}/columnar"), "document": spark.read.schema("p_partkey bigint").json(f"{folder}/document")}
    counts = [df.agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n")) for name, df in stored.items()]
    return counts[0].unionByName(counts[1])


@query(
    "k2_dedup_write",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def k2_dedup_write(spark, d):
    bucket = _bucket(spark, "docs", id_column="doc_id")
    docs = table(spark, d, "documents").select("doc_id", "source")
    writers.write_results(docs, bucket, dedup_configured=True)
    incoming = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("source"))
    config = DedupConfig(order=("doc_id",), policy="overwrite", fields=("doc_id",), id_column="doc_id")
    result = dedup(incoming, readers.scan_stage(spark, bucket), config)
    writers.write_results(result.emit, bucket, dedup_configured=True, delete_ids=result.delete)
    return readers.scan_stage(spark, bucket)


@query("k8_json_stage", "SELECT p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_type")
def k8_json_stage(spark, d):
    bucket, parts = _bucket(spark, "parts"), table(spark, d, "part").select("p_type", "p_size")
    writers.write_stage(parts, bucket, "json", settings=writers.WriteSettings(codec="gz", batch_max_objects=5000))
    stored = readers.scan_stage(spark, bucket, "json", schema=parts.schema)
    return stored.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))


@query("k10_messages", "SELECT event_id, event_type, value FROM events")
def k10_messages(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return writers.to_messages(events).select(F.from_json("value", events.schema).alias("r")).select("r.*")


@query("k11_target_folders", "SELECT '/out/' || lang AS target, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang")
def k11_target_folders(spark, d):
    target = F.when(F.col("lang") != "en", F.concat(F.lit("/out/"), "lang"))
    routed = table(spark, d, "documents").select("doc_id", target.alias(routing.TARGET))
    folder = work_folder(spark, "targets")
    writers.write_partitioned_targets(routing.emit_allowed(routed, ["/out/*"]).external, folder)
    return spark.read.parquet(folder).groupBy(F.col(routing.TARGET).cast("string").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("k14_atomic_replace", "SELECT p_partkey, p_retailprice * 2 AS price, CAST(1 AS BIGINT) AS versions FROM part")
def k14_atomic_replace(spark, d):
    folder = work_folder(spark, "replaced")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    for _ in range(2):
        versioned.replace_folder(parts, folder)
    doubled = spark.read.parquet(versioned.current_folder(spark, folder)).withColumn("price", F.col("price") * 2)
    versioned.replace_folder(doubled, folder)
    versioned.remove_old_versions(spark, folder, keep=1)
    left = len(layout.list_folders(spark, f"{folder}/versions"))
    return spark.read.parquet(versioned.current_folder(spark, folder)).withColumn("versions", F.lit(left).cast("bigint"))


@query("k19_purge", "SELECT 0::BIGINT AS n, columns FROM (SELECT string_agg(name, ',') AS columns FROM pragma_table_info('orders'))")
def k19_purge(spark, d):
    folder = work_folder(spark, "purged")
    versioned.replace_folder(table(spark, d, "orders"), folder)
    versioned.purge(spark, folder)
    left = spark.read.parquet(versioned.current_folder(spark, folder))
    return left.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(",".join(left.columns)))


@query("k20_table", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part")
def k20_table(spark, d):
    folder = work_folder(spark, "table")
    name = "parts_" + folder[-8:]
    declared = writers.table_format_of({"p_partkey": "STRING", "p_size": "BIGINT", "extra": "[STRING INT]"})
    writers.write_table(table(spark, d, "part"), name, declared, bucket_by=(4, ["p_partkey"]), folder=folder)
    return spark.table(name).select("p_partkey", "p_size")


@query(
    "f9_job_state",
    "SELECT lang, count(*) AS seen, CAST(2 AS BIGINT) AS runs FROM documents GROUP BY lang",
)
def f9_job_state(spark, d):
    state = state_bucket(_bucket(spark, "docs", id_column="lang"), "counting", "languages")
    counted = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("seen"), F.lit(1).cast("bigint").alias("runs"))
    writers.write_upsert(counted, state)
    again = Update().increment("runs", 1).apply(readers.scan_stage(spark, state))
    writers.write_upsert(again, state)
    return readers.scan_stage(spark, state)
