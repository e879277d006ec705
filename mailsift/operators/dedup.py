"""Exact deduplication (D1) and its accounting.

D1 keeps, per ``(scope, fingerprint)``, the row that comes first in an explicit order
(``order_col``).  It is written as ``min_by`` in a ``groupBy`` so that Spark aggregates
partially before the shuffle: a fingerprint copied millions of times (one hot group can
hold a third of the corpus) leaves each map task as a single row, never as one giant
group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_keep_first(df: DataFrame, fp_col: str = "fp", order_col: str = "doc_id",
                     scope: tuple[str, ...] = ()) -> DataFrame:
    """First row per fingerprint within ``scope`` (e.g. the class branch)."""
    keys = [*scope, fp_col]
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    kept = df.groupBy(*keys).agg(F.min_by(packed, F.col(order_col)).alias("_d1"))
    return kept.select(*keys, *[F.col("_d1")[c].alias(c) for c in others]).select(*df.columns)


def duplicate_accounting(df: DataFrame, fp_col: str = "fp", scope: tuple[str, ...] = ()) -> DataFrame:
    """Rows, distinct fingerprints and rows lost to D1, per scope.

    Counted as a two-level aggregation (per fingerprint, then per scope) so that a hot
    fingerprint is reduced map-side instead of being held in a distinct-set.
    """
    per_fp = df.groupBy(*scope, fp_col).agg(F.count(F.lit(1)).alias("_copies"))
    return (per_fp.groupBy(*scope)
            .agg(F.sum("_copies").cast("bigint").alias("n_rows"),
                 F.count(F.lit(1)).cast("bigint").alias("n_distinct"))
            .withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct")))
