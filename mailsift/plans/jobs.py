"""End-to-end jobs with the parameters of the original command-line programs.

* :func:`label_eml_directory` — every message of a directory, one label, compact profile,
  written as the labelled CSV (the "parse a labelled mail folder" program).
* :func:`prepare_training_data` — positives from a mail folder (masked profile, exact dedup,
  cap), as many distinct synthetic negatives, shuffled, written as the labelled CSV.
* :func:`train` — labelled CSV (or the built-in sample) → seeded split → naive Bayes fit →
  validation metrics → model saved.
* :func:`score` / :func:`explain` — batch scoring and top-k token explanations with a
  saved model.

All of them are Spark jobs; the only values that reach the driver are counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.hashing import hash_key
from ..functions.text import clean_compact, clean_masked, compose, fingerprint
from ..operators import evaluate as V
from ..operators.audit import funnel_outcome
from ..operators import synth as G
from ..operators.classify import load_model, nb_explain, nb_fit, nb_predict, save_model
from ..operators.compute import with_computed
from ..operators.dedup import dedup_keep_first
from ..operators.epochs import fit_epochs, predict_weights
from ..operators.mime import choose_body, parse_messages
from ..operators.sample import cap_rows, positive_cap, seeded_shuffle, train_val_split
from ..session import materialize
from ..sources.eml import scan_messages
from ..sources.labelled import builtin_sample, read_labelled_csv, write_labelled_csv


def _parsed(spark: SparkSession, input_dir: str, glob: str) -> DataFrame:
    return parse_messages(scan_messages(spark, input_dir, glob))


def label_eml_directory(spark: SparkSession, input_dir: str, output_csv: str, label: int,
                        include_subject: bool = True, min_length: int = P.MIN_TEXT_LENGTH,
                        glob: str = "*.eml") -> dict:
    """Compact profile: body (raw) ≥ 10 characters, optional subject, whole-text cleaning,
    cleaned text ≥ ``min_length``; every kept row gets ``label``. Returns the counts."""
    if label not in (0, 1):
        raise ValueError("label must be 0 (legitimate) or 1 (phishing)")
    msgs = with_computed(_parsed(spark, input_dir, glob),
                         body=choose_body("parts", "multipart", "compact"))
    subject = F.col("subject") if include_subject else F.lit("")
    text = with_computed(msgs, email_text=clean_compact(compose(subject, F.col("body"))))
    ok_body = (F.col("parse_status") == "ok") & (F.length("body") >= P.COMPACT_MIN_BODY)
    tagged = materialize(text.select("email_text", ok_body.alias("ok_body")))
    kept = tagged.where(F.col("ok_body") & (F.length("email_text") >= int(min_length)))
    write_labelled_csv(kept.withColumn("label", F.lit(int(label))), output_csv)
    found = tagged.count()
    processed = kept.count()
    return {"found": found, "processed": processed, "skipped": found - processed}


def clean_positives(spark: SparkSession, phishing_dir: str, glob: str = "*.eml",
                    min_length: int = P.MIN_TEXT_LENGTH) -> DataFrame:
    """Masked profile per message: subject ≤ 200 and body ≤ 2000 cleaned, composed text,
    fingerprint and A2 ``outcome`` (body ≥ 30, text ≥ ``min_length``); with the message path as id."""
    msgs = with_computed(_parsed(spark, phishing_dir, glob),
                         body=choose_body("parts", "multipart", "masked"))
    cleaned = with_computed(msgs, subject_c=clean_masked("subject", P.MASKED_SUBJECT_MAX_CHARS),
                            body_c=clean_masked("body", P.MASKED_BODY_MAX_CHARS))
    text = cleaned.withColumn("email_text", compose("subject_c", "body_c"))
    outcome = funnel_outcome(F.length("body_c"), F.length("email_text"), P.MASKED_MIN_BODY, int(min_length),
                             F.col("parse_status") == "ok")
    return text.select("path", "email_text", outcome.alias("outcome"), fingerprint("email_text").alias("fp"))


def prepare_training_data(spark: SparkSession, phishing_dir: str, output_csv: str, max_samples: int = 2000,
                          balance_ratio: float = 1.0, glob: str = "*.eml") -> dict:
    """Positives: cleaned, deduplicated (first in the seeded processing order wins), capped;
    negatives: ``int(positives × balance_ratio)`` distinct synthetic mails; shuffled CSV. Returns the
    counts of the file and the funnel of the messages (A2)."""
    tagged = materialize(clean_positives(spark, phishing_dir, glob))
    pos = tagged.where(F.col("outcome") == "passed").drop("outcome").withColumn("_order", hash_key("process", "path"))
    unique = materialize(dedup_keep_first(pos, "fp", "_order"))
    funnel = {r["outcome"]: r["count"] for r in tagged.groupBy("outcome").count().collect()}
    collected = unique.count()
    capped = materialize(cap_rows(unique, positive_cap(max_samples, balance_ratio), "path")
                         .select(F.concat(F.lit("mail "), "path").alias("doc_id"), "email_text", F.lit(1).alias("label")))
    n_pos = capped.count()
    if n_pos == 0:
        raise RuntimeError("no phishing e-mails could be processed")
    n_neg = int(n_pos * balance_ratio)
    seeds = spark.range(n_pos).select(F.col("id").alias("seed"))
    negatives = G.generate_distinct(seeds, "seed", n_neg) if n_neg > 0 else None
    corpus = capped
    if negatives is not None:
        corpus = corpus.unionByName(negatives.select(F.concat(F.lit("synthetic "), F.col("cand_id")).alias("doc_id"), "email_text",
                                                     F.lit(0).alias("label")))
    write_labelled_csv(seeded_shuffle(corpus, "doc_id"), output_csv)
    written = read_labelled_csv(spark, output_csv)
    counts = {r["label"]: r["n"] for r in written.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {"total": total, "phishing": counts.get(1, 0), "legitimate": counts.get(0, 0),
            "est_minutes": total // 200, "found": sum(funnel.values()), "parse_error": funnel.get("parse_error", 0),
            "too_short": funnel.get("short_body", 0) + funnel.get("short_text", 0),
            "duplicate": funnel.get("passed", 0) - collected, "collected": collected}


def _split_rows(data: DataFrame, val_ratio: float) -> DataFrame:
    """Labelled rows with a ``doc_id`` and their seeded ``part``. Equal rows are rows of their own: the
    copies are numbered, so that ids are unique."""
    copies = data.groupBy("email_text", "label").agg(F.count(F.lit(1)).alias("n"))
    data = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))) \
        .select("email_text", "label", F.sha2(F.to_json(F.struct("label", "copy", "email_text")), 256).alias("doc_id"))
    return materialize(train_val_split(data, "doc_id", val_ratio))


def train(spark: SparkSession, csv_path: str | None, model_dir: str, val_ratio: float = 0.2,
          alpha: float = 1.0, max_length: int = P.MAX_TOKENS, in_splits: bool = False) -> DataFrame:
    """Labelled CSV (or the built-in sample when no path is given) → seeded split → fit →
    validation metrics (returned) → model saved under ``model_dir``. ``in_splits`` reads large files in
    splits."""
    split = _split_rows(read_labelled_csv(spark, csv_path, in_splits) if csv_path else builtin_sample(spark), val_ratio)
    table, priors = nb_fit(split.where(F.col("part") == "train"), "email_text", "label", alpha,
                           max_tokens=max_length)
    save_model(table, priors, model_dir)
    val = split.where(F.col("part") == "val")
    pred = val.select("doc_id", "label").join(nb_predict(val, table, priors, max_tokens=max_length), "doc_id")
    return V.classification_metrics(pred)


def train_in_epochs(spark: SparkSession, csv_path: str | None, model_dir: str, epochs: int = 3,
                    batch_size: int | None = None, learning_rate: float = 1.0, val_ratio: float = 0.2,
                    max_length: int = P.MAX_TOKENS, weight_decay: float = 0.01, in_splits: bool = False) -> DataFrame:
    """Like :func:`train`, by gradient descent: ``epochs`` passes in steps of ``batch_size`` rows (null: all).
    Returns the history, a row per epoch; the weights of every epoch stay under ``model_dir`` and those
    of the epoch with the highest recall become its ``best``."""
    split = _split_rows(read_labelled_csv(spark, csv_path, in_splits) if csv_path else builtin_sample(spark), val_ratio)
    fit = fit_epochs(split.where(F.col("part") == "train"), split.where(F.col("part") == "val"), model_dir, epochs,
                     batch_size, learning_rate, weight_decay, max_tokens=max_length)
    fit.weights(spark).write.mode("overwrite").parquet(f"{model_dir}/best")
    return fit.table(spark)


def score_epochs(spark: SparkSession, model_dir: str, df: DataFrame, text_col: str = "email_text",
                 id_col: str = "doc_id", max_length: int = P.MAX_TOKENS) -> DataFrame:
    """``(id, p_1, pred)`` with the best weights that :func:`train_in_epochs` left."""
    return predict_weights(df, spark.read.parquet(f"{model_dir}/best"), text_col, id_col, max_tokens=max_length)


def score(spark: SparkSession, model_dir: str, df: DataFrame, text_col: str = "email_text",
          id_col: str = "doc_id", max_length: int = P.MAX_TOKENS) -> DataFrame:
    """Batch scoring with a saved model: label name and winning probability per row."""
    table, priors = load_model(spark, model_dir)
    return nb_predict(df.withColumnRenamed(text_col, "email_text"), table, priors, "email_text", id_col, max_length)


def explain(spark: SparkSession, model_dir: str, df: DataFrame, text_col: str = "email_text",
            id_col: str = "doc_id", top_k: int = P.TOP_K, max_length: int = P.MAX_TOKENS) -> DataFrame:
    """Top-k tokens per row pushing it toward the positive class."""
    table, _ = load_model(spark, model_dir)
    return nb_explain(df.withColumnRenamed(text_col, "email_text"), table, "email_text", id_col, top_k, max_length)
