"""Corpus preparation jobs (G3-style composition over the corpus tables).

``prepare_corpus``: documents ⋈ labels → clean (masked) → length filters → fingerprint →
keep-first dedup inside each class → class balance → train/validation split.
Shuffles: the labels join unless the labels are small enough to broadcast, the dedup aggregation
(partial, keyed by class and fingerprint) and two tiny count aggregations; the balance and split are
literal threshold predicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clean_masked, fingerprint
from ..session import materialize
from ..operators.compute import with_computed
from ..operators.dedup import dedup_keep_first
from ..operators.sample import class_balance, train_val_split
from ..sources.tables import documents, labels


def clean_labelled(spark: SparkSession, base_dir: str, label_col: str = "toxic",
                   min_length: int = P.MIN_TEXT_LENGTH) -> DataFrame:
    """Labelled, cleaned, length-filtered rows with their fingerprint.

    One equi-join on ``doc_id``, before cleaning, so only labelled documents are cleaned; AQE
    broadcasts the labels when their measured bytes allow it.
    """
    lab = labels(spark, base_dir, "doc_id", label_col).select(
        "doc_id", F.col(label_col).cast("int").alias("label"))
    docs = documents(spark, base_dir, "doc_id", "text", "source")
    cleaned = with_computed(docs.join(lab, "doc_id").select("doc_id", "label", "source", "text"),
                            email_text=clean_masked("text")).drop("text")
    kept = cleaned.where((F.length("email_text") >= P.MASKED_MIN_BODY)
                         & (F.length("email_text") >= int(min_length)))
    return kept.withColumn("fp", fingerprint("email_text"))


def prepare_corpus(spark: SparkSession, base_dir: str, label_col: str = "toxic",
                   balance_ratio: float = 1.0, val_ratio: float = 0.2,
                   min_length: int = P.MIN_TEXT_LENGTH, materialized: bool = False) -> DataFrame:
    """``materialized=True`` cuts the lineage of the result too, for callers that run
    several actions over it (model fitting, grids)."""
    rows = clean_labelled(spark, base_dir, label_col, min_length)
    unique = materialize(dedup_keep_first(rows, "fp", "doc_id", scope=("label",)))
    balanced = class_balance(unique, "doc_id", balance_ratio, "label")
    corpus = train_val_split(balanced, "doc_id", val_ratio)
    return materialize(corpus) if materialized else corpus
