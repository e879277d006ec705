"""Training in epochs, split joins, leave-one-source-out, TF-IDF, the run log and found boilerplate."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.operators import audit as A
from mailsift.operators import epochs as E
from mailsift.operators import joins as J
from mailsift.operators.classify import nb_fit, nb_leave_one_out, nb_predict
from mailsift.operators.features import sparse_vectors, tfidf_weights
from mailsift.operators.runlog import logged_run, rank_runs
from mailsift.session import scratch_path

BAD = "please verify your account password now click the link {} urgent"
GOOD = "the monthly meeting is moved to {} please bring the report and notes"


def _mails(spark, n=60):
    rows = [(i, (BAD if i % 2 else GOOD).format(f"word{i % 7} " * (i % 3)), i % 2, f"s{i % 3}") for i in range(n)]
    rows += [(n, "", 1, "s0"), (n + 1, "123 !", 0, "s1"), (n + 2, None, 0, "s9")]
    return spark.createDataFrame(rows, "doc_id long, email_text string, label int, source string")


def _vector(text, size):
    tf = Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % size for t in re.findall(r"[^\W\d_]+", (text or "").lower())[:P.MAX_TOKENS])
    norm = math.sqrt(sum(v * v for v in tf.values())) or 1
    return {**{k: v / norm for k, v in tf.items()}, size: 1.0}


def _probability(x, w):
    return 1 / (1 + math.exp(-sum(v * w.get(k, 0.0) for k, v in x.items())))


@pytest.mark.parametrize("batch_size", [None, 20])
def test_epochs_equal_plain_descent(spark, batch_size):
    size, rate, decay = 64, 1.5, 0.02
    df = _mails(spark)
    train, val = df.where("doc_id % 4 <> 0"), df.where("doc_id % 4 = 0")
    fit = E.fit_epochs(train, val, scratch_path(spark, "t-epochs"), 3, batch_size, rate, decay, num_features=size)
    rows = [(r["doc_id"], _vector(r["email_text"], size), r["label"]) for r in train.collect()]
    held = [(_vector(r["email_text"], size), r["label"]) for r in val.collect()]
    n_batches = -(-len(rows) // batch_size) if batch_size else 1
    w, want = {}, []
    for epoch in (1, 2, 3):
        draw = lambda i: int(hashlib.md5(f"epoch{epoch}:{P.SEED}:{i}:batch".encode()).hexdigest()[:8], 16) % n_batches  # noqa: E731,B023
        for b in range(n_batches):
            part = [(x, y) for i, x, y in rows if draw(i) == b]
            if not part:
                continue
            g = Counter()
            for x, y in part:
                r = _probability(x, w) - y
                for k, v in x.items():
                    g[k] += r * v / len(part)
            w = {k: w.get(k, 0.0) - rate * (g.get(k, 0.0) + (decay * w.get(k, 0.0) if k < size else 0)) for k in set(w) | set(g)}
        ps = [(_probability(x, w), y) for x, y in held]
        loss = sum(-math.log(p if y else 1 - p) for p, y in ps) / len(ps)
        found = sum(p > 0.5 for p, y in ps if y) / sum(y for _, y in ps)
        want.append((epoch, round(loss, 9), round(found, 9)))
    assert [(h["epoch"], round(h["val_loss"], 9), round(h["recall"], 9)) for h in fit.history] == want
    best = max(want, key=lambda h: (h[2], -h[0]))[0]
    assert fit.best_epoch == best and [r["epoch"] for r in fit.table(spark).where("best").collect()] == [best]
    last = {r["idx"]: r["w"] for r in spark.read.parquet(fit.best_path.replace(f"epoch={best}", "epoch=3")).collect()}
    assert len(last) == size + 1 and all(abs(last[k] - v) < 1e-9 for k, v in w.items())


def test_train_in_epochs_job(spark):
    from mailsift.plans import jobs
    from mailsift.sources.labelled import write_labelled_csv
    csv, model = scratch_path(spark, "t-csv"), scratch_path(spark, "t-model")
    write_labelled_csv(_mails(spark, 80).where("email_text <> ''"), csv)
    history = jobs.train_in_epochs(spark, csv, model, epochs=2, batch_size=40, learning_rate=3.0, weight_decay=0.0)
    rows = history.collect()
    assert [r["epoch"] for r in rows] == [1, 2] and sum(r["best"] for r in rows) == 1 and rows[1]["train_loss"] < 0.6
    out = {r["doc_id"]: r["pred"] for r in jobs.score_epochs(spark, model, _mails(spark, 10).where("doc_id < 10")).collect()}
    assert out == {i: i % 2 for i in range(10)}


def _most_and_median(df, keys):
    """Rows of the largest and the median partition when ``df`` is dealt by ``keys``."""
    n = sorted(r["count"] for r in df.repartition(8, *keys).groupBy(F.spark_partition_id()).count().collect())
    return n[-1], n[len(n) // 2]


def test_split_join_deals_a_token_of_all_documents(spark):
    left = spark.range(40_000).select(F.col("id").alias("doc"), F.explode(F.array(
        F.lit("the"), F.concat(F.lit("w"), F.col("id") % 5000), F.lit(None).cast("string"))).alias("token"))
    right = left.select("token").where("token is not null").distinct().withColumn("n", F.length("token"))
    counts = left.where("token is not null").groupBy("token").count()
    heavy = J.heavy_of_counts(counts, ["token"], "count")
    assert [k for k, _ in heavy] == [("the",)] and heavy[0][1] > 8
    joined = J.split_join(left, right, ["token"], heavy, ["doc"])
    plain = left.join(right, "token", "left")
    assert joined.columns == ["token", "doc", "n"] and joined.exceptAll(plain.select(joined.columns)).count() == 0
    assert joined.count() == plain.count()
    plan = joined._jdf.queryExecution().toString()
    assert "_piece" in plan.split("== Physical Plan ==")[1]
    before = _most_and_median(left, ["token"])
    pieces = F.when(F.col("token").isNull(), 8).when(F.col("token") == "the", heavy[0][1]).otherwise(1)
    dealt = left.withColumn("piece", F.pmod(F.xxhash64("doc"), pieces))
    after = _most_and_median(dealt, ["token", "piece"])
    assert before[0] > 2 * before[1] and after[0] <= 2 * after[1]


def test_scores_join_by_pieces(spark):
    table, priors = nb_fit(_mails(spark).where("label is not null"))
    plan = nb_predict(_mails(spark), table, priors)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "_piece" in plan


def test_leave_one_source_out_equals_separate_fits(spark):
    df = _mails(spark)
    got = {r["doc_id"]: (round(r["p_1"], 9), r["pred"]) for r in nb_leave_one_out(df).collect()}
    want = {}
    for s in ("s0", "s1", "s2", "s9"):
        table, priors = nb_fit(df.where(F.col("source") != s))
        want |= {r["doc_id"]: (round(r["p_1"], 9), r["pred"]) for r in nb_predict(df.where(F.col("source") == s), table, priors).collect()}
    assert got == want and len(got) == 63


def test_tfidf_equals_plain(spark):
    df = _mails(spark, 20)
    texts = {r["doc_id"]: re.findall(r"[^\W\d_]+", (r["email_text"] or "").lower()) for r in df.collect()}
    df_of = Counter(t for ts in texts.values() for t in set(ts))
    place = {t: k for k, t in enumerate(sorted(df_of), 1)}
    got = {r["doc_id"]: (r["indices"], r["values"]) for r in sparse_vectors(tfidf_weights(df, "email_text")).collect()}
    assert set(got) == {i for i, ts in texts.items() if ts}
    for i, (indices, values) in got.items():
        tf = Counter(texts[i])
        assert indices == sorted(place[t] for t in tf)
        want = {place[t]: n * math.log((len(texts) + 1) / (df_of[t] + 1)) for t, n in tf.items()}
        assert all(abs(v - want[k]) < 1e-12 for k, v in zip(indices, values))


def test_run_log_ranks_by_recall_then_latency(spark):
    import duckdb
    log = scratch_path(spark, "t-log")
    scored = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, pred int")
    row = logged_run(scored, "a", log, {"alpha": 1.0})
    assert (row["rows"], row["tn"], row["fp"], row["fn"], row["tp"], row["recall"], row["accuracy"]) == (4, 2, 0, 1, 1, 0.5, 0.75)
    assert row["ms_per_row"] > 0
    logged_run(scored.withColumn("pred", F.col("label")), "b", log)
    logged_run(scored, "c", log)
    logged_run(scored.limit(0), "none", log)
    got = [(r["run"], r["rank"]) for r in rank_runs(spark.read.parquet(log)).orderBy("rank").collect()]
    want = duckdb.sql(f"SELECT run, row_number() OVER (ORDER BY recall DESC, accuracy DESC, ms_per_row, run) AS rank "
                      f"FROM '{log}/*.parquet' ORDER BY rank").fetchall()
    assert got == want and got[0][0] == "b" and got[-1][0] == "none"


def test_frames_found_in_the_mails(spark):
    formal = [f"Subject: s{i}\n\nDear {('Ann', 'Bob')[i % 2]},\n\ntext number {i}\n\nKind regards,\nCarla" for i in range(40)]
    free = [f"a message of its own {i} with nothing in common {i * 7}" for i in range(60)]
    rows = [(0, t) for t in formal] + [(1, t) for t in free] + [(1, None), (1, ""), (1, "\n \n")]
    df = spark.createDataFrame(rows, "label int, email_text string")
    found = {(r["frame"], r["value"]): r["n"] for r in A.frequent_frames(df, "email_text", 0.1).collect()}
    assert found == {("opening", "dear"): 40, ("addressee", "Ann"): 20, ("addressee", "Bob"): 20, ("closing", "Kind regards,"): 40,
                     ("signature", "Carla"): 40, ("opening", "a"): 60}
    rates = {r["label"]: r.asDict() for r in A.found_boilerplate_rate(df, "email_text", min_share=0.1).collect()}
    assert (rates[0]["closing_rate"], rates[0]["any_rate"], rates[1]["closing_rate"], rates[1]["n"]) == (1.0, 1.0, 0.0, 63)
    assert A.frequent_frames(df.limit(0), "email_text").count() == 0


def test_proxy_tokens_of_one_class(spark):
    rows = [(1, 1, "a"), (2, 1, "a"), (2, 1, "b")]
    got = A.label_proxy_tokens(spark.createDataFrame(rows, "doc_id long, label int, token string")).collect()
    assert got and all(r["score"] is not None for r in got)
