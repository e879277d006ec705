"""Streaming jobs equal their batch answers (W1–W3), including the watermark-bounded dedup."""

from pyspark.sql import functions as F

from conftest import SF001
from mailsift.functions.text import fingerprint
from mailsift.session import scratch_path
from mailsift.sources.tables import documents
from mailsift.streaming import jobs as W


def _stage(spark, with_time=False):
    d = documents(spark, SF001, "doc_id", "text")
    if with_time:
        d = d.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")))
    path = W.stage_files(d, scratch_path(spark, "t-stream"), 6)
    return W.read_stream(spark, path, d.schema, max_files_per_trigger=2), d


def test_dedup_within_watermark_equals_batch(spark):
    stream, batch = _stage(spark, with_time=True)
    s = stream.select("doc_id", "ts", fingerprint("text").alias("fp"))
    sink = W.run_to_parquet(W.dedup(s, "fp", event_time="ts", delay="1 day"), "t-dedup-wm")
    got = {r.fp for r in spark.read.parquet(sink).collect()}
    exp = {r.fp for r in batch.select(fingerprint("text").alias("fp")).distinct().collect()}
    assert got == exp
    assert spark.read.parquet(sink).count() == len(exp)


def test_survivors_from_keyed_state(spark):
    """Any order of arrival; a batch reads its rows and their state, never the sink."""
    rows = [(9, "a"), (3, "b"), (7, "a"), (8, None), (2, "a"), (5, None), (4, "b"), (1, "c")]
    path = scratch_path(spark, "t-arrive")
    for k, r in enumerate(rows):        # one file each, read in this order
        spark.createDataFrame([r], "doc_id long, fp string").coalesce(1).write.parquet(f"{path}/{k}")
    stream = (spark.readStream.schema("doc_id long, fp string").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(path))
    sink = W.dedup_batches(stream, "t-keyed")
    got = {(r.fp, r.doc_id) for r in W.survivors(spark, sink).collect()}
    assert got == {("a", 2), ("b", 3), (None, 5), ("c", 1)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != W.ROCKSDB


def test_state_expires_with_the_period(spark):
    """Within a period one row stays; behind the watermark its state is gone and late rows are dropped."""
    day = 86_400
    rows = [(5, "a", 0), (4, "a", 3), (9, "a", 40), (8, "b", 41), (1, "a", 1), (7, "a", 41)]      # (id, fp, day), 10-day periods
    path = scratch_path(spark, "t-expire")
    for k, (i, fp, d) in enumerate(rows):
        spark.createDataFrame([(i, fp, 1_700_006_400 + d * day)], "doc_id long, fp string, s long") \
            .select("doc_id", "fp", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{path}/{k}")
    stream = (spark.readStream.schema("doc_id long, fp string, ts timestamp").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(path))
    sink = W.dedup_batches(stream, "t-expire", event_time="ts", delay="1 day", keep_for="10 days")
    got = {(r.fp, r.doc_id) for r in W.survivors(spark, sink).collect()}
    assert ("a", 7) in got and ("b", 8) in got and ("a", 1) not in got
    assert ("a", 4) in got and len(got) == 3


def test_running_funnel_equals_batch(spark):
    from mailsift.functions.text import clean_masked
    from mailsift.operators.audit import ingest_funnel
    from mailsift.operators.compute import with_computed
    stream, batch = _stage(spark)

    def rows(df):
        return with_computed(df, body=clean_masked("text")).select("body", fingerprint("body").alias("fp"))
    sink = W.running_funnel(rows(stream), "t-funnel", "body", "body", "fp")
    got = {(r.outcome, r.n) for r in W.funnel_so_far(spark, sink).collect()}
    assert got == {(r.outcome, r.n) for r in ingest_funnel(rows(batch), "body", "body", "fp").collect()}
    assert spark.read.parquet(sink).groupBy("batch").count().agg(F.max("count")).first()[0] <= 4


def test_funnel_of_an_empty_stream(spark):
    path = scratch_path(spark, "t-none")
    spark.createDataFrame([], "body string, fp string").write.parquet(path)
    stream = W.read_stream(spark, path, spark.read.parquet(path).schema)
    sink = W.running_funnel(stream, "t-none", "body", "body", "fp")
    import os
    os.makedirs(sink, exist_ok=True)
    assert {(r.outcome, r.n) for r in W.funnel_so_far(spark, sink).collect()} == {("collected", 0), ("duplicate", 0)}


def test_messages_stream_within_the_limit(spark):
    from mailsift.plans.q_mime import ingest, message_fixture
    from mailsift.sources.eml import scan_messages, stream_messages, write_messages
    root = scratch_path(spark, "t-messages")
    n = write_messages(message_fixture(spark, SF001), root)
    sink, progress = W.append_batches(ingest(stream_messages(spark, root, max_files_per_trigger=100)), "t-ingest")
    got, want = spark.read.parquet(sink).drop("batch"), ingest(scan_messages(spark, root))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == n
    assert sum(p["rows"] for p in progress) >= n and len(progress) > 1
    assert W.ms_per_row(progress) < 3000          # the source's limit for one message
