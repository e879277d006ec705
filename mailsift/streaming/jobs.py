"""Structured Streaming jobs (W1–W3): continuous ingest, clean and score, continuous dedup and a
running ingest funnel over a directory of arriving files.

W1 is a stateless projection, from message files on. W2 and W3 are streaming aggregations by
fingerprint in update mode: their state lies in RocksDB on the executors, so it may exceed the
memory, and a micro-batch reads its own rows and the state of their keys, nothing of earlier output.
Checkpoints and sinks live under the shared checkpoint folder, so a restarted query resumes where
it stopped; a replayed micro-batch overwrites its own folder of the sink.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.text import clean_masked, fingerprint
from ..operators.audit import funnel_outcome
from ..operators.compute import with_computed
from ..operators.dedup import dedup_keep_first
from ..operators.rules import any_keyword
from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of an arriving file at most, if their number is not given.
FILE_ROWS = 8192


def stage_files(df: DataFrame, path: str, n_files: int | None = None) -> str:
    """Write ``df`` as Parquet files, the arriving files of a stream: as many as its partitions and FILE_ROWS
    need, so that their number grows with the data and one file is a short task, or ``n_files``."""
    (df.repartition(n_files) if n_files else df).write.option("maxRecordsPerFile", 0 if n_files else FILE_ROWS).mode("overwrite").parquet(path)
    return path


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 2) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


@contextmanager
def _started_with(spark: SparkSession, stateful: bool):
    """The settings of a query. A micro-batch may hold 10^5 small files: a task reads as many as
    their bytes allow, and few tasks look them up. With state: in RocksDB, in as many partitions as task
    slots (they are fixed for the life of a stream's checkpoint)."""
    slots = spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.files.openCostInBytes": str(64 << 10),
              "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * slots)}
    if stateful:
        wanted |= {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(slots)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(stream: DataFrame, name: str, write, output_mode: str = "append", stateful: bool = False) -> list[dict]:
    """Run ``write(batch, epoch)`` over all that is available now. Returns, per micro-batch, its rows and
    milliseconds from the query's progress."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(output_mode).foreachBatch(write) \
        .option("checkpointLocation", scratch_path(spark, f"{name}-ckpt")).trigger(availableNow=True)
    with _started_with(spark, stateful):
        running = query.start()
        running.awaitTermination()      # the source looks its files up with the caller's settings, while it runs
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["durationMs"].get("triggerExecution", 0)}
            for p in running.recentProgress if p["numInputRows"]]


def run_to_parquet(stream: DataFrame, name: str, output_mode: str = "append") -> str:
    """Run a streaming plan over everything available now and return its sink folder."""
    spark = stream.sparkSession
    sink, ckpt = scratch_path(spark, f"{name}-sink"), scratch_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.outputMode(output_mode).format("parquet").option("path", sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return sink


def append_batches(stream: DataFrame, name: str) -> tuple[str, list[dict]]:
    """Write every micro-batch of a projection, such as parsed and cleaned message files. Returns
    the sink folder and the micro-batches with their rows and times."""
    sink = scratch_path(stream.sparkSession, f"{name}-sink")
    progress = _run(stream, name, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{sink}/batch={epoch}"))
    return sink, progress


def ms_per_row(progress: list[dict]) -> float:
    """The slowest micro-batch's time per row, in milliseconds."""
    return max((p["ms"] / p["rows"] for p in progress), default=0.0)


def clean_and_score(stream: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """T11 (masked) → fingerprint → keyword-rule flag, per arriving row."""
    c = with_computed(stream.select(id_col, text_col), email_text=clean_masked(text_col))
    return c.select(id_col, "email_text", fingerprint("email_text").alias("fp"),
                    any_keyword("email_text").alias("flagged"))


def score_batches(stream: DataFrame, table: DataFrame, priors: DataFrame, name: str,
                  id_col: str = "doc_id") -> str:
    """W1 with the classifier: every micro-batch of cleaned rows is scored with the fitted
    model (a keyed batch job per micro-batch via ``foreachBatch``) and appended to a Parquet
    sink together with its cleaning outputs. Returns the sink folder."""
    from ..operators.classify import nb_predict
    sink = scratch_path(stream.sparkSession, f"{name}-sink")

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # one folder per micro-batch, overwritten on replay: a batch re-run after a failure
        # replaces its own output instead of appending it twice
        batch = batch.persist()     # cleaned once, read by the scoring and by the join
        try:
            scored = nb_predict(batch.select(id_col, "email_text"), table, priors, "email_text", id_col)
            out = batch.join(scored.select(id_col, "p_1", "pred"), id_col)
            out.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")
        finally:
            batch.unpersist()

    _run(stream, name, write_batch)
    return sink


def first_by_key(stream: DataFrame, key_col: str = "fp", order_col: str = "doc_id", event_time: str | None = None,
                 delay: str = "1 day", keep_for: str = "30 days") -> DataFrame:
    """W2 with D1's survivor: per key the row with the smallest ``order_col`` so far, whatever the order
    of arrival, to be run in update mode. With ``event_time`` the rows of a key are one only within
    periods of ``keep_for``, and a period's state is dropped once the watermark (``delay`` behind
    the latest event) has passed its end; rows that come later than that are dropped."""
    rest = [c for c in stream.columns if c != key_col]
    if event_time:
        stream = stream.withWatermark(event_time, delay)
    keys = [F.window(event_time, keep_for).alias("period")] if event_time else []
    kept = stream.groupBy(*keys, key_col).agg(F.min_by(F.struct(*rest), order_col).alias("_kept"))
    return kept.select(key_col, *[F.col(f"_kept.{c}").alias(c) for c in rest],
                       *([F.col("period.start").alias("period")] if event_time else []))


def dedup_batches(stream: DataFrame, name: str, fp_col: str = "fp", order_col: str = "doc_id", **expiry) -> str:
    """``first_by_key`` as a running job. A micro-batch writes the keys whose survivor it touched;
    ``survivors`` reads the sink, whose folder is returned."""
    sink = scratch_path(stream.sparkSession, f"{name}-sink")

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    _run(first_by_key(stream, fp_col, order_col, **expiry), name, write_batch, "update", stateful=True)
    return sink


def survivors(spark: SparkSession, sink: str, fp_col: str = "fp", order_col: str = "doc_id") -> DataFrame:
    """The rows that ``dedup_batches`` has kept so far, one per fingerprint (and period): of a key that
    several micro-batches wrote, the smallest, which is the latest."""
    rows = spark.read.parquet(sink).drop("batch")
    return dedup_keep_first(rows, fp_col, order_col, scope=("period",) if "period" in rows.columns else ())


def dedup(stream: DataFrame, fp_col: str = "fp", event_time: str | None = None,
          delay: str = "1 day") -> DataFrame:
    """D1 across micro-batches. Without an event time the state keeps every fingerprint
    seen; with one, ``dropDuplicatesWithinWatermark`` bounds it by the watermark."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([fp_col])
    return stream.dropDuplicates([fp_col])


def funnel_state(stream: DataFrame, body_col: str, text_col: str, fp_col: str, min_body: int = P.MASKED_MIN_BODY,
                 min_text: int = P.MIN_TEXT_LENGTH, parsed_col: str | None = None) -> DataFrame:
    """W3, to be run in update mode: ``(outcome, fp, n, first_seen, last_seen)``, the rows so far of each
    outcome (null fingerprint) and of each fingerprint that passed. The times are those of the
    micro-batches, so a fingerprint is new in a micro-batch if they are equal."""
    outcome = funnel_outcome(F.length(body_col), F.length(text_col), min_body, min_text,
                             F.col(parsed_col) if parsed_col else None)
    key = F.struct(outcome.alias("outcome"), F.lit(None).cast("string").alias("fp"))
    own = F.struct(outcome.alias("outcome"), F.col(fp_col).alias("fp"))
    keyed = stream.select(F.inline(F.when(outcome == "passed", F.array(key, own)).otherwise(F.array(key))))
    seen = keyed.withColumn("_seen", F.current_timestamp())
    return seen.groupBy("outcome", "fp").agg(F.count(F.lit(1)).alias("n"), F.min("_seen").alias("first_seen"),
                                             F.max("_seen").alias("last_seen"))


def running_funnel(stream: DataFrame, name: str, body_col: str, text_col: str, fp_col: str, **limits) -> str:
    """The whole A2 funnel as a running job. A micro-batch writes at most one row per outcome: the
    rows so far, and how many of the passing fingerprints are new. Returns the sink folder;
    ``funnel_so_far`` reads it."""
    sink = scratch_path(stream.sparkSession, f"{name}-sink")

    def write_batch(batch: DataFrame, epoch: int) -> None:
        new = F.count_if(F.col("fp").isNotNull() & (F.col("first_seen") == F.col("last_seen")))
        batch.groupBy("outcome").agg(F.max(F.when(F.col("fp").isNull(), F.col("n"))).alias("rows"), new.alias("new")) \
            .write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    _run(funnel_state(stream, body_col, text_col, fp_col, **limits), name, write_batch, "update", stateful=True)
    return sink


def funnel_so_far(spark: SparkSession, sink: str) -> DataFrame:
    """``(outcome, n)``: found, parse_error, short_body, short_text, collected and duplicate so far; an
    outcome that no row reached is absent but for collected and duplicate."""
    per = spark.read.schema(T.StructType.fromDDL("outcome string, rows bigint, new bigint")).parquet(sink) \
        .groupBy("outcome").agg(F.max("rows").alias("rows"), F.sum("new").alias("new"))
    of = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("rows")))
    one = per.agg(F.sum("rows").alias("found"), *[of(o).alias(o) for o in ("parse_error", "short_body", "short_text")],
                  F.coalesce(F.sum("new"), F.lit(0)).cast("bigint").alias("collected"), F.coalesce(of("passed"), F.lit(0)).alias("passed"))
    long = one.select(F.expr("stack(6, 'found', found, 'parse_error', parse_error, 'short_body', short_body, 'short_text', short_text, "
                             "'collected', collected, 'duplicate', passed - collected) as (outcome, n)"))
    return long.where(F.col("n").isNotNull())
