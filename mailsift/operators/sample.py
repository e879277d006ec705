"""Seeded orders, exact-N samples, class balance and train/validation split.

Order = md5 of a per-stage salt and the row id (``functions.hashing.hash_key``); every "first
n rows" below is computed with :func:`mailsift.operators.ranking.flag_first_n`, which is exact
and never sorts or shuffles the full table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from .ranking import flag_first_n, first_n

SHUFFLE_STAGE = "shuffle"
SAMPLE_STAGE = "sample"
SPLIT_STAGE = "split"
CAP_STAGE = "cap"


def with_order_key(df: DataFrame, stage: str, id_col: str, out: str = "order_key") -> DataFrame:
    """The row's position key for ``stage``."""
    return df.withColumn(out, hash_key(stage, id_col))


def seeded_shuffle(df: DataFrame, id_col: str, stage: str = SHUFFLE_STAGE) -> DataFrame:
    """Rows in a reproducible pseudo-random order (a range-partitioned sort)."""
    return with_order_key(df, stage, id_col, "_p1").orderBy("_p1", id_col).drop("_p1")


def exact_n_sample(df: DataFrame, n: int, id_col: str, stage: str = SAMPLE_STAGE,
                   partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """Exactly ``min(n, rows)`` rows per partition, the first by the stage's hash order."""
    keyed = with_order_key(df, stage, id_col, "_p2")
    return first_n(keyed, "_p2", id_col, int(n), partition_cols).drop("_p2")


def cap_rows(df: DataFrame, n: int, id_col: str, stage: str = CAP_STAGE,
             partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """L1: stop after ``n`` accepted rows (which rows: the first in the cap order)."""
    return exact_n_sample(df, n, id_col, stage, partition_cols)


def positive_cap(max_samples: int, balance_ratio: float) -> int:
    """L2: positives are capped at half the budget only for an exact 1:1 balance."""
    return max_samples // 2 if balance_ratio == 1.0 else max_samples


def class_balance(df: DataFrame, id_col: str, ratio: float = 1.0, label_col: str = "label",
                  positive: int = 1, stage: str = SAMPLE_STAGE) -> DataFrame:
    """Keep every positive and ``int(positives × ratio)`` negatives (hash-ordered)."""
    keyed = with_order_key(df, stage, id_col, "_p3")

    def cap(totals: dict) -> dict:
        n_pos = totals.get((positive,), 0)
        return {p: (n if p == (positive,) else int(n_pos * ratio)) for p, n in totals.items()}

    return first_n(keyed, "_p3", id_col, cap, (label_col,)).drop("_p3")


def train_val_split(df: DataFrame, id_col: str, val_ratio: float = 0.2, stage: str = SPLIT_STAGE,
                    part_col: str = "part") -> DataFrame:
    """The first ``max(1, int(n × val_ratio))`` rows of the split order are validation,
    the rest training; not stratified."""
    keyed = with_order_key(df, stage, id_col, "_p4")

    def cap(totals: dict) -> dict:
        return {p: max(1, int(n * val_ratio)) for p, n in totals.items()}

    flagged = flag_first_n(keyed, "_p4", id_col, cap, "_is_val")
    return (flagged.withColumn(part_col, F.when(F.col("_is_val"), F.lit("val")).otherwise(F.lit("train")))
            .drop("_p4", "_is_val"))


def holdout_by_source(df: DataFrame, holdout_sources, source_col: str = "source",
                      part_col: str = "part") -> DataFrame:
    """P5: rows of the listed origins are the evaluation part, all others training."""
    return df.withColumn(part_col, F.when(F.col(source_col).isin(list(holdout_sources)), F.lit("test"))
                         .otherwise(F.lit("train")))


def first_per_class(df: DataFrame, text_col: str, order_col: str, label_col: str = "label") -> DataFrame:
    """L3: the first row of each class in a given order (partial aggregation, no sort)."""
    return df.groupBy(label_col).agg(F.min_by(F.col(text_col), F.col(order_col)).alias(text_col))
