"""Storage: layouts, slices, versions, upserts, codecs, targets; and streams into them."""

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docsieve.operators import grouped, routing, timeslice
from docsieve.operators.dedup import DedupConfig
from docsieve.operators.grouped import BatchModule
from docsieve.operators.query import all_of
from docsieve.plans.enrichment import Step, last_outputs, run_steps
from docsieve.sources import readers, versioned, writers
from docsieve.sources.layout import Bucket
from docsieve.sources.readers import Input
from docsieve.streaming import batches, cuts, stateful
from docsieve.streaming.stored import dedup_into, merge_source

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = dt.datetime(2024, 6, 30)


@pytest.fixture
def bucket(tmp_path):
    return Bucket("/a/b", str(tmp_path), time_field="t", slice_period="month")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"r{i}", dt.datetime(2024, 1 + i % 6, 1 + i % 28), i) for i in range(120)], "_id string, t timestamp_ntz, v int").cache()


def test_sliced_write_prunes_partitions(spark, bucket, rows):
    writers.write_sliced(rows, bucket, policy="record", files_per_slice=2, settings=writers.WriteSettings(codec="gz", batch_max_objects=7))
    folders = sorted(path.name for path in Path(bucket.stage()).iterdir() if path.is_dir())
    assert folders == [f"__slice=2024.{month:02d}" for month in range(1, 7)]
    files = list(Path(bucket.stage()).rglob("*.parquet"))
    assert len(files) >= 18 and all(".gz." in path.name for path in files)
    coarse = readers.scan_input(spark, Input("x", bucket, time_min="3 months", time_max="1 month"), NOW)
    assert {row["__slice"] for row in coarse.select("__slice").distinct().collect()} == {"2024.03", "2024.04", "2024.05"}
    plan = coarse._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__slice" in plan and "__slice" in plan.split("PartitionFilters: [")[1].split("]")[0]
    exact = readers.scan_input(spark, Input("x", bucket, time_min="3 months", time_max="1 month", exact_times=True), NOW)
    low, high = dt.datetime(2024, 3, 30), dt.datetime(2024, 5, 30)
    assert exact.count() == rows.filter((F.col("t") >= F.lit(low)) & (F.col("t") <= F.lit(high))).count()


def test_dated_folders(spark, tmp_path):
    for name in ("x_2024.01.05", "x_2024.02.05", "x_2024.02.06_10", "other"):
        spark.createDataFrame([(name,)], "name string").write.json(f"{tmp_path}/{name}")
    got = readers.scan_dated_folders(spark, str(tmp_path), dt.datetime(2024, 2, 1), None, schema=spark.createDataFrame([], "name string").schema)
    assert sorted(row["name"] for row in got.collect()) == ["x_2024.02.05", "x_2024.02.06_10"]
    with pytest.raises(FileNotFoundError):
        readers.scan_dated_folders(spark, f"{tmp_path}/none", None, None)


def test_file_records(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.bin", "twelve bytes"), ("sub/c.txt", "3")):
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    folder = str(tmp_path / "files")
    assert readers.count_files(spark, folder).first()["n"] == 3
    records = readers.scan_binary(spark, folder, "*.txt")
    assert sorted((row["path"].rsplit("/", 1)[-1], bytes(row["content"])) for row in records.collect()) == [("a.txt", b"one"), ("c.txt", b"3")]
    assert readers.scan_binary(spark, folder, with_content=False).columns == ["path", "length", "modificationTime"]


def test_timed_batches(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = readers.stream_folder(spark, f"{tmp_path}/in", spark.range(1).schema, max_files=1)
    seen = []
    query = batches.run_batches(stream, lambda frame, batch_id: seen.append((batch_id, frame.count())), f"{tmp_path}/checkpoint", every="100 milliseconds", name="timed")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [batch_id for batch_id, _ in seen] == [0, 1, 2] and sum(count for _, count in seen) == 6


def test_replace_is_a_switch(spark, tmp_path, rows):
    folder = f"{tmp_path}/data"
    versioned.replace_folder(rows, folder)
    before = spark.read.parquet(versioned.current_folder(spark, folder))
    versioned.replace_folder(before.filter("v < 10"), folder)
    assert spark.read.parquet(versioned.current_folder(spark, folder)).count() == 10
    assert before.count() == 120  # a reader that resolved the pointer earlier still has its data
    versioned.purge(spark, folder)
    assert len(versioned.remove_old_versions(spark, folder, keep=1)) == 2
    left = spark.read.parquet(versioned.current_folder(spark, folder))
    assert left.count() == 0 and left.columns == ["_id", "t", "v"]


def test_sliced_bucket_set_prunes(spark, tmp_path, rows):
    root = f"{tmp_path}/with blank"
    one = Bucket("/logs/one", root, time_field="t", slice_period="month")
    two = Bucket("/logs/two", root, time_field="t", slice_period="month")
    untimed = spark.createDataFrame([("u", None, 999)], rows.schema)
    writers.write_sliced(rows.unionByName(untimed), one, policy="record")
    writers.write_sliced(rows, two, policy="record")
    both = readers.scan_bucket_set(spark, [one, two, Bucket("/other", root)], ["/logs/*"])
    assert {r["__bucket"]: r["count"] for r in both.groupBy("__bucket").count().collect()} == {"/logs/one": 121, "/logs/two": 120}
    first = rows.agg(F.min("t")).first()[0]
    low, high = first - dt.timedelta(days=4000), first + dt.timedelta(days=4000)
    for bounds, kept in (((low, None), 240), ((None, high), 240), ((low, high), 240), ((None, None), 241)):
        assert timeslice.sliced_scan(both, "t", "month", *bounds).count() == kept
    pruned = timeslice.sliced_scan(both, "t", "month", high, None)
    assert pruned.count() == 0 and "PartitionFilters: [isnotnull(__slice" in pruned._jdf.queryExecution().executedPlan().toString()


def test_write_modes(spark, bucket, rows):
    assert writers.write_results(rows, bucket, dedup_configured=True) == "upsert"
    changes = rows.filter("v >= 100").withColumn("v", F.col("v") + 1000)
    writers.write_results(changes, bucket, dedup_configured=True, delete_ids=rows.filter("v < 5").select("_id"))
    stored = readers.scan_stage(spark, bucket)
    assert stored.count() == 115 and stored.filter("v >= 1000").count() == 20
    other = Bucket("/plain", bucket.root)
    for _ in range(2):
        assert writers.write_results(rows, other, dedup_configured=False) == "append"
    assert readers.scan_stage(spark, other).count() == 240


def test_routing_and_fan_out(spark, tmp_path):
    df = spark.createDataFrame([(1, ("/test",)), (2, ("$bad",)), (3, (None,)), (4, ("/out/x",))], "id int, object_field struct<field string>")
    targets = lambda output: {row["id"]: row["__target"] for row in routing.route(df, output).collect()}
    assert targets(None) == targets("$$internal") == {1: None, 2: None, 3: None, 4: None}
    assert targets("$$stop") == {}
    assert targets("$object_field.field") == {1: "/test", 4: "/out/x"}
    assert targets("$object_field.none") == {} and targets("/lit")[1] == "/lit"
    emission = routing.emit_allowed(routing.route(df, "$object_field.field"), ["/out/*"])
    assert [row["id"] for row in emission.external.collect()] == [4]
    assert [(row["id"], row["__reason"]) for row in emission.errors.collect()] == [(1, "target not in the allow-list")]
    assert routing.emit_allowed(routing.route(df, "/out/y"), ["/out/*"], test_mode=True).external.count() == 0
    calls = []
    first, second = (lambda frame: calls.append(("a", frame.count()))), (lambda frame: calls.append(("b", frame.count())))
    routing.fan_out(df, {"one": first, "same": first, "two": second})
    assert calls == [("a", 4), ("b", 4)]
    folder = str(tmp_path / "targets")
    writers.write_partitioned_targets(routing.route(df, "/out/y"), folder)
    assert spark.read.parquet(folder).count() == 4


def test_write_size_and_flush(spark, tmp_path, rows):
    settings = writers.WriteSettings(batch_max_size_kb=0.5, target_write_concurrency=1, batch_flush_interval="5 seconds")
    settings.writer(rows, "json").save(f"{tmp_path}/sized")
    files = [path.read_bytes() for path in Path(f"{tmp_path}/sized").glob("*.json*")]
    assert len(files) > 8 and settings.flush() == {"every": "5 seconds"}
    assert writers.WriteSettings().flush() == {}


def test_steps(spark):
    df = spark.range(10)
    steps = [
        Step("even", lambda d: d.filter("id % 2 = 0")),
        Step("big", lambda d: d.filter("id > 5")),
        Step("odd", lambda d: d.filter("id % 2 = 1"), ("$inputs",)),
        Step("off", lambda d: d, ("odd",), enabled=False),
        Step("needs_off", lambda d: d, ("$previous",)),
        Step("both", lambda d: d.groupBy("__input").count(), ("big", "odd")),
    ]
    outputs = run_steps({"in": df}, steps)
    assert list(outputs) == ["even", "big", "odd", "both"]
    assert {row["__input"]: row["count"] for row in outputs["both"].collect()} == {"big": 2, "odd": 5}
    assert list(last_outputs({"in": df}, steps)) == ["both"]
    with pytest.raises(ValueError):
        run_steps({"in": df}, [Step("a", lambda d: d, ("later",)), Step("later", lambda d: d)])


class Tally(BatchModule):
    def setup(self, options):
        self.seen = 0

    def batch(self, rows):
        self.seen += len(rows)

    def complete(self):
        return pd.DataFrame({"n": [self.seen]})


def _bounds(frame):
    return pd.concat([group.iloc[[0]].assign(n=len(group)) for group in grouped.each_group(frame, ["k"])])


def test_modules_and_whole_groups(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"), F.col("id"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert sum(row["n"] for row in grouped.batch_apply(df, Tally, "n bigint").collect()) == 1000
        got = grouped.sorted_groups(df, ["k"], ["id"], _bounds, "k bigint, id bigint, n bigint").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((row["k"] or 0, row["id"], row["n"]) for row in got) == [(k, k, 143 if k < 6 else 142) for k in range(7)]


def test_stream_dedup_is_idempotent(spark, tmp_path):
    folder = f"{tmp_path}/store"
    settings = DedupConfig(order=("seq",), policy="overwrite", fields=("k",))
    handle = dedup_into(folder, settings)
    one = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 1, 3)], "_id string, k int, seq int")
    two = spark.createDataFrame([("d", 1, 4), ("e", 3, 5)], "_id string, k int, seq int")
    for frame, batch_id in ((one, 0), (two, 1), (two, 1), (one, 0)):
        handle(frame, batch_id)
    stored = spark.read.parquet(versioned.current_folder(spark, folder))
    assert {tuple(row) for row in stored.collect()} == {("c", 1, 4), ("b", 2, 2), ("e", 3, 5)}


def test_stream_dedup_loses_nothing(spark, tmp_path):
    settings = DedupConfig(order=("seq",), policy="overwrite", fields=("k",), delete_unhandled=True)
    schema = "_id string, k int, seq int"
    store, inputs = f"{tmp_path}/store", f"{tmp_path}/in"
    # a store first made by other means, with two rows of one key
    versioned.replace_folder(spark.createDataFrame([("z", 1, 0), ("y", 1, 0), ("x", 9, 0)], schema), store)
    for name, frames in (("one", [[("a", 1, 1)], [("b", 2, 2)]]), ("two", [[("c", 3, 3)], [("d", 2, 4)]])):
        for number, rows in enumerate(frames):  # each stream has a fresh checkpoint, so its batches start from 0 again
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{inputs}-{name}")
            stream = readers.stream_folder(spark, f"{inputs}-{name}", spark.createDataFrame([], schema).schema, max_files=1)
            batches.run_batches(stream, dedup_into(store, settings), f"{tmp_path}/checkpoint-{name}").awaitTermination()
    stored = spark.read.parquet(versioned.current_folder(spark, store))
    # the surplus row of key 1 is gone, and the stored id of key 2 is taken over
    assert {tuple(row) for row in stored.collect()} == {("y", 1, 1), ("x", 9, 0), ("b", 2, 4), ("c", 3, 3)}
    assert sorted(versioned.batch_marks(spark, store).values()) == [1, 1]


def test_merge_source_marks_deletions(spark):
    emit = spark.createDataFrame([("a", 1)], "_id string, k int")
    delete = spark.createDataFrame([("a",), ("b",), ("b",)], "_id string")
    assert {tuple(r) for r in merge_source(emit, delete, "_id").collect()} == {("a", 1, False), ("b", None, True)}


def test_stream_serves_new_files_once(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{name}" for name in ("in", "out", "checkpoint"))
    schema = "id bigint"
    for count in (5, 7):
        spark.range(count).write.mode("append").parquet(source)
        stream = readers.stream_folder(spark, source, spark.createDataFrame([], schema).schema)
        batches.emit_to_folder(all_of().range_above("id", 1).filter(stream), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 4 + 6


def test_stream_rules_over_several_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    schema = spark.createDataFrame([], "k string, id bigint, at bigint, v double").schema
    try:
        out = None
        for start in (0, 10):
            rows = [("k1", i, i * 100, float(i)) for i in range(start, start + 10)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = readers.stream_folder(spark, f"{tmp_path}/in", schema)
            rules = stateful.Rules(every_nth=5, every_ms=100_000)
            merged = stateful.running_merge_stream(stream, "k", "at", "v", "id", rules)
            batches.emit_to_folder(merged, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert [(row["id"], row["merge_count"], row["merge_sum"]) for row in out] == [(0, 1, 0.0), (4, 5, 10.0), (9, 10, 45.0), (14, 15, 105.0), (19, 20, 190.0)]
    assert (out[-1]["pair_min"], out[-1]["pair_max"]) == (18.0, 19.0)


def test_cuts_against_brute_force(spark):
    df = spark.range(100).select(F.col("id"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("s"))
    for hot in ({}, {"chunks": 1}, {"chunks": 6}):
        assert {row["id"]: row["__batch"] for row in batches.cut_by_count(df, ["id"], 7, **hot).collect()} == {i: i // 7 for i in range(100)}
        got = {row["id"]: row["__batch"] for row in batches.cut_by_size(df, ["id"], 0.25, **hot).collect()}
        position = 0
        for i in range(100):
            assert got[i] == position // 256
            position += len('{"id":%d,"s":"%s"}' % (i, "x" * (i % 9)))


def test_stream_cuts_are_exact_and_repeatable(spark, tmp_path):
    sizes = [5, 0, 1, 17, 3, 12]
    rows, start = [], 0
    for number, size in enumerate(sizes):
        rows.append([(start + i, None if i % 4 == 0 else "x" * (i * 7 % 50)) for i in range(size)])
        start += size
    frames = [spark.createDataFrame(part, "id long, t string") for part in rows]
    flat = [row for part in rows for row in part]

    def weight(row, by_size):
        text = '{"id":%d}' % row[0] if row[1] is None else '{"id":%d,"t":"%s"}' % row
        return len(text) if by_size else 1

    for name, limit, unit in (("count", {"rows": 4}, 4), ("size", {"kilobytes": 0.1}, 102.4)):
        folder, handed = f"{tmp_path}/{name}", []

        def keep(df, part):
            handed.append((part, sorted((r["__batch"], r["id"]) for r in df.collect())))

        fail = [True]

        def keep_or_fail(df, part):
            keep(df, part)
            if part == 3 and fail:
                fail.pop()
                raise RuntimeError("lost")

        cut = cuts.cut_into(folder, ["id"], handle=keep_or_fail, chunks=3, **limit)
        for number, frame in enumerate(frames):
            try:
                cut(frame, number)
            except RuntimeError:
                cut(frame, number)  # the micro-batch is run again: same cuts, same part
            cut(frame, number)  # run again behind its end: nothing
        before, want = 0, []
        for row in flat:
            want.append((int(before // unit), row[0]))
            before += weight(row, name == "size")
        whole = cuts.full_batches(spark, folder, with_open=True, **limit)
        assert sorted((r["__batch"], r["id"]) for r in whole.collect()) == want
        full = [pair for pair in want if pair[0] < int(before // unit)]
        assert sorted((r["__batch"], r["id"]) for r in cuts.full_batches(spark, folder, **limit).collect()) == full
        repeated = [pairs for part, pairs in handed if part == 3]
        assert len(repeated) == 2 and repeated[0] == repeated[1]
        assert sorted({pair for _, pairs in handed for pair in pairs}) == full
        # another checkpoint starts counting anew and goes on behind what is there
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", "other")
        try:
            cut(spark.createDataFrame([(1000, "y")], "id long, t string"), 0)
        finally:
            spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
        last = cuts.full_batches(spark, folder, with_open=True, **limit).filter("id = 1000").first()["__batch"]
        assert last == int(before // unit)
    with pytest.raises(ValueError):
        cuts.cut_into(str(tmp_path), ["id"])


def test_age_out_with_grace(spark, tmp_path, rows):
    bucket = Bucket("/aged", str(tmp_path), time_field="t", slice_period="month")
    writers.write_sliced(rows, bucket, policy="record")
    everything = readers.scan_stage(spark, bucket).count()
    expired = [slice_ for (slice_,) in timeslice.with_slice(rows, "t", "month", "record").select("__slice").distinct().collect() if slice_ and slice_ < "2024.04"]
    before = readers.scan_stage(spark, bucket)
    assert writers.age_out_stage(spark, bucket, "processed", "2 months", NOW, grace="1 hour") == []
    young = readers.scan_stage(spark, bucket).count()
    assert expired and young < everything == before.count()  # who listed the files earlier still reads them all
    assert writers.age_out_stage(spark, bucket, "processed", "2 months", NOW + dt.timedelta(minutes=30), grace="1 hour") == []
    gone = writers.age_out_stage(spark, bucket, "processed", "2 months", NOW + dt.timedelta(hours=2), grace="1 hour")
    assert sorted(folder.rsplit("=", 1)[1] for folder in gone) == sorted(expired)
    assert readers.scan_stage(spark, bucket).count() == young == spark.read.parquet(bucket.stage()).count()
    assert writers.age_out_stage(spark, bucket, "processed", "2 months", NOW, grace="1 hour") == []


def test_age_out(spark, rows):
    sliced = timeslice.with_slice(rows, "t", "month", "record")
    kept = timeslice.age_out(sliced, "t", "2 months", NOW, period="month")
    assert kept.count() == rows.filter(F.col("t") >= F.lit(dt.datetime(2024, 4, 30))).count()
