"""Operator properties and golden numbers (FIXTURES.md §6), brute-force cross-checks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001, SF01
from mailsift.functions.hashing import hash_key
from mailsift.operators import evaluate as V
from mailsift.operators.classify import argmax, predict, softmax
from mailsift.operators.dedup import dedup_keep_first, duplicate_accounting
from mailsift.operators.ranking import first_n, global_position
from mailsift.operators.sample import positive_cap, train_val_split


def test_softmax_argmax_golden(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (1, [0.0, 0.0]), (2, [2.0, -1.0])], "i int, l array<double>")
    rows = df.orderBy("i").select(F.transform(softmax("l"), lambda x: F.round(x, 6)).alias("p"),
                                  argmax(softmax("l")).alias("k")).collect()
    assert [list(r.p) for r in rows] == [[0.119203, 0.880797], [0.5, 0.5], [0.952574, 0.047426]]
    assert [r.k for r in rows] == [1, 0, 0]


def test_predict_names_and_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0],)], "logits array<double>")
    r = predict(df).collect()[0]
    assert r.pred == 1 and r.pred_label == "phishing" and round(r.score, 6) == 0.880797
    assert round(r.p_positive, 6) == 0.880797


def _conf_rows(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame(rows, "label int, pred int")


def test_metrics_golden(spark):
    m = V.classification_metrics(_conf_rows(spark, 145, 1, 0, 128)).collect()[0]
    assert (m.tn, m.fp, m.fn, m.tp) == (145, 1, 0, 128)
    assert (m.accuracy, m.precision, m.recall, m.f1, m.fpr) == (0.99635, 0.992248, 1.0, 0.996109, 0.006849)
    assert m.overfit_alarm is False


def test_metrics_zero_division_and_alarm(spark):
    m = V.classification_metrics(_conf_rows(spark, 5, 0, 3, 0)).collect()[0]
    assert m.precision == 0.0 and m.f1 == 0.0 and m.recall == 0.0
    perfect = V.classification_metrics(_conf_rows(spark, 47, 0, 0, 37)).collect()[0]
    assert perfect.overfit_alarm is True


def test_refusal_rate_golden(spark):
    from mailsift.operators.audit import refusal_rate
    rows = [("g1", "I'm sorry, I cannot help with that")] * 182 + [("g1", "Hola equipo, adjunto el informe")] * 118
    df = spark.createDataFrame(rows, "generator string, text string")
    r = refusal_rate(df, "text").collect()[0]
    assert (r.sent, r.refused, r.valid, r.refusal_rate) == (300, 182, 118, 0.606667)


def test_half_cap():
    assert positive_cap(2000, 1.0) == 1000 and positive_cap(2000, 0.5) == 2000


@pytest.mark.parametrize("n,expected", [(1374, (1100, 274)), (2000, (1600, 400)), (6, (5, 1)), (1, (0, 1))])
def test_split_sizes(spark, n, expected):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    parts = {r.part: r["count"] for r in train_val_split(df, "doc_id", 0.2).groupBy("part").count().collect()}
    assert (parts.get("train", 0), parts.get("val", 0)) == expected


def test_split_disjoint_and_reproducible(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    a = train_val_split(df, "doc_id").where("part = 'val'").select("doc_id")
    b = train_val_split(df.repartition(7), "doc_id").where("part = 'val'").select("doc_id")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


@pytest.mark.parametrize("cap", [0, 1, 37, 250, 999, 5000])
def test_first_n_equals_global_sort(spark, cap):
    rnd = random.Random(cap)
    rows = [(i, rnd.choice(["a", "b", "c"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, g string").withColumn("k", hash_key("t", "doc_id"))
    got = {(r.g, r.doc_id) for r in first_n(df, "k", "doc_id", cap, ("g",), prefix_len=2).collect()}
    w = Window.partitionBy("g").orderBy("k", "doc_id")
    exp = {(r.g, r.doc_id) for r in df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).collect()}
    assert got == exp


def test_global_position_equals_row_number(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("k", hash_key("shuffle", "doc_id"))
    got = {(r.doc_id, r.pos) for r in global_position(df, "k", "doc_id", "pos").collect()}
    exp = {(r.doc_id, r.rn) for r in df.withColumn("rn", F.row_number().over(Window.orderBy("k", "doc_id"))).collect()}
    assert got == exp


def test_dedup_idempotent_and_counts(spark):
    from mailsift.functions.text import fingerprint
    from mailsift.sources.tables import documents
    d = documents(spark, SF01, "doc_id", "text").withColumn("fp", fingerprint("text"))
    once = dedup_keep_first(d, "fp", "doc_id")
    assert once.count() == 927
    assert dedup_keep_first(once, "fp", "doc_id").count() == 927
    acc = duplicate_accounting(d, "fp").collect()[0]
    assert (acc.n_rows, acc.n_distinct, acc.n_duplicates) == (1000, 927, 73)
    # keep-first: the survivor of each group has the smallest id
    mins = d.groupBy("fp").agg(F.min("doc_id").alias("m"))
    assert once.join(mins, "fp").where(F.col("doc_id") != F.col("m")).count() == 0


def test_stream_dedup_equals_batch(spark):
    from __spark_entry__ import queries
    from mailsift.functions.text import fingerprint
    from mailsift.sources.tables import documents
    s = {(r.doc_id, r.fp) for r in queries()["stream_dedup"](spark, SF01).collect()}
    d = documents(spark, SF01, "doc_id", "text").select("doc_id", fingerprint("text").alias("fp"))
    b = {(r.doc_id, r.fp) for r in dedup_keep_first(d, "fp", "doc_id").collect()}
    assert s == b and len(s) == 927


@pytest.mark.parametrize("base,expected", [
    (SF001, {(0, "train", 9), (0, "val", 2), (1, "train", 9), (1, "val", 2)}),
    (SF01, {(0, "train", 41), (0, "val", 9), (1, "train", 39), (1, "val", 11)}),
])
def test_flagship_golden(spark, base, expected):
    from __spark_entry__ import queries
    got = {(r.label, r.part, r.n) for r in queries()["prepare_corpus_counts"](spark, base).collect()}
    assert got == expected


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["label", "part", "n"] and df.count() == 4


def test_builtin_sample_and_csv_roundtrip(spark, tmp_path):
    from mailsift.sources.labelled import builtin_sample, read_labelled_csv, write_labelled_csv
    s = builtin_sample(spark)
    assert [r.label for r in s.collect()] == [1, 0, 1, 0, 1, 0]
    tricky = spark.createDataFrame([('say "hi"\r\nline2, \\x ', 1), ("  padded  ", 0)], "email_text string, label int")
    path = str(tmp_path / "csv")
    write_labelled_csv(s.unionByName(tricky), path)
    back = read_labelled_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, s.unionByName(tricky).collect()))


def test_prompt_grid(spark):
    from mailsift.operators.synth import prompt_grid
    g = prompt_grid(spark)
    assert g.count() == 1944 and g.distinct().count() == 1944


def test_corpus_scores_are_probabilities(spark):
    from __spark_entry__ import queries
    from mailsift.operators.classify import nb_fit, nb_predict
    from mailsift.plans.corpus import prepare_corpus
    corpus = prepare_corpus(spark, SF001, materialized=True)
    train, val = corpus.where("part = 'train'"), corpus.where("part = 'val'")
    assert train.join(val, "doc_id").count() == 0
    table, priors = nb_fit(train)
    p = nb_predict(val, table, priors)
    assert p.count() == val.count()
    assert p.where(F.abs(F.col("p_0") + F.col("p_1") - 1) > 1e-9).count() == 0
    assert p.where(F.col("score") < 0.5).count() == 0


@pytest.mark.parametrize("cap", [1, 700, 2999])
def test_first_n_refines_hot_edge_buckets(spark, cap):
    # a 1-hex-digit histogram and a rank limit of 50 rows force several refinement rounds
    df = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("k", hash_key("r", "doc_id"))
    got = {r.doc_id for r in first_n(df, "k", "doc_id", cap, prefix_len=1, max_rank_rows=50).collect()}
    exp = {r.doc_id for r in df.orderBy("k", "doc_id").limit(cap).collect()}
    assert got == exp


def test_flagship_same_with_shuffled_label_join(spark):
    """A shuffle join with the labels gives the same corpus as a broadcast."""
    from __spark_entry__ import queries
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    try:
        got = {(r.label, r.part, r.n) for r in queries()["prepare_corpus_counts"](spark, SF01).collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    assert got == {(0, "train", 41), (0, "val", 9), (1, "train", 39), (1, "val", 11)}


def test_global_position_spreads_a_hot_key(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("k", F.when(F.col("doc_id") % 3 == 0, "same")
                                                                         .otherwise(hash_key("g", "doc_id")))
    got = {(r.doc_id, r.pos) for r in global_position(df, "k", "doc_id", "pos").collect()}
    exp = {(r.doc_id, r.rn) for r in df.withColumn("rn", F.row_number().over(Window.orderBy("k", "doc_id"))).collect()}
    assert got == exp


def test_first_n_and_positions_keep_null_groups_and_keys(spark):
    rows = [(i, None if i % 2 else "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, lang string").withColumn("k", hash_key("n", "doc_id"))
    for cap, want in ((3, 6), (100, 20)):
        got = first_n(df, "k", "doc_id", cap, ("lang",)).collect()
        assert len(got) == want and sum(r.lang is None for r in got) == want // 2
    pos = global_position(df, "k", "doc_id", "pos", ("lang",)).collect()
    assert sorted((r.lang or "", r.pos) for r in pos) == sorted((v, p) for v in ("", "en") for p in range(1, 11))
    keyless = df.withColumn("k", F.when(F.col("doc_id") % 4 != 0, F.col("k")))
    pos = global_position(keyless, "k", "doc_id", "pos").collect()
    assert sorted(r.pos for r in pos) == list(range(1, 21))
    assert {r.doc_id for r in pos if r.pos <= 5} == {0, 4, 8, 12, 16}


def test_generated_rows_are_never_short(spark):
    from mailsift.operators import synth
    seeds = spark.range(30).withColumnRenamed("id", "seed")
    got = synth.generate_distinct(seeds, "seed", 90).collect()
    assert len(got) == 90 and len({r.fp for r in got}) == 90
    with pytest.raises(RuntimeError, match="requested"):
        synth.generate_distinct(spark.range(0).withColumnRenamed("id", "seed"), "seed", 1)


def test_train_numbers_repeated_rows(spark, tmp_path):
    from mailsift.operators.sample import train_val_split
    from mailsift.plans import jobs
    rows = [(f"text number {i % 4} word{i % 4}", i % 2) for i in range(100)]
    path = str(tmp_path / "train")
    spark.createDataFrame(rows, "email_text string, label int").coalesce(1).write.csv(path, header=True)
    m = jobs.train(spark, path, str(tmp_path / "model"), val_ratio=0.2).collect()[0]
    assert m.tn + m.fp + m.fn + m.tp == 20


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from mailsift import session
    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(SimpleNamespace(sparkContext=sc))
