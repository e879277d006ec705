"""Steps whose cost must grow no faster than their input: what is shuffled, listed and dealt to tasks."""

import os
import re

from pyspark.sql import functions as F

from conftest import SF001
from mailsift.session import scratch_path


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attention_is_shuffled_as_texts_only(spark):
    from mailsift.plans import q_model
    for query in (q_model.attention_topk, q_model.attention_lists):
        assert _plan(query(spark, SF001)).count("Exchange hashpartitioning") == 1


def test_tfidf_counts_are_made_in_place(spark):
    from mailsift.operators.features import tfidf_weights
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (1, "a c"), (3, None)], "doc_id long, text string")
    weights = tfidf_weights(docs, "text")
    assert not re.search(r"hashpartitioning\(doc_id#\d+L, token#", _plan(weights))
    got = {(r.doc_id, r.token) for r in weights.collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (2, "b")}        # rows of one id are one document


def test_arriving_files_are_short_tasks(spark):
    from mailsift.streaming import jobs as W
    path = W.stage_files(spark.range(3 * W.FILE_ROWS).coalesce(1), scratch_path(spark, "t-files"))
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3


def test_a_task_of_a_stream_reads_many_small_files(spark, tmp_path):
    from mailsift.sources.eml import stream_messages
    from mailsift.streaming import jobs as W
    for i in range(200):
        (tmp_path / f"{i}.eml").write_bytes(b"Subject: s\r\n\r\nbody\r\n")
    tasks, key = [], "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(128 << 20))
    try:
        W._run(stream_messages(spark, str(tmp_path)), "t-small", lambda batch, _: tasks.append(batch.rdd.getNumPartitions()))
        assert spark.conf.get(key) == str(128 << 20)
    finally:
        spark.conf.set(key, before)
    assert 0 < sum(tasks) <= 16


def test_scan_lists_in_tasks_what_the_reader_lists(spark, tmp_path):
    from mailsift.sources.eml import scan_messages
    for name in ("a.eml", "x/b.eml", "x/y/c.eml", "x/y/d.txt", "_hidden/e.eml", "x/.f.eml", "z/k=_1/g.eml", "x/_e.eml", "empty.eml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "empty.eml" else name.encode())
    got = scan_messages(spark, str(tmp_path))
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(str(tmp_path))
    assert not any(f.endswith(".eml") for f in got.inputFiles())      # the driver holds no file names
    ms = F.date_trunc("second", "modificationTime")
    got, want = got.withColumn("modificationTime", ms), want.withColumn("modificationTime", ms)
    assert got.count() == want.count() == 4 and got.exceptAll(want).count() == 0
    assert scan_messages(spark, f"{tmp_path}/x/b.eml").count() == 1


def test_patterns_that_skip_single_spaces(spark):
    from mailsift.functions import patterns as P
    from mailsift.functions import text as X
    chars = [chr(c) for c in P.WS_CODEPOINTS] + list("a.@-") + ["​", "\x84", "b@c.d", "w" * 50]
    rows = [(x + a + b + c + "z",) for a in chars for b in chars for c in chars for x in ("", "q")]
    d = spark.createDataFrame(rows, "x string")
    for new, pattern, by in ((X.collapse_whitespace("x"), P.ALL_WS_PATTERN, " "), (X.collapse_blanks("x"), P.BLANKS_PATTERN, " "),
                             (X.mask_emails("x"), P.EMAIL_PATTERN, P.EMAIL_MARK), (X.mask_long_words("x"), f"{P.WORD}{{50,}}", P.ENCODED_MARK)):
        assert d.where(new != F.regexp_replace("x", pattern, by)).count() == 0
