"""Token importance from a stored attention table (A9, F7, K1, J3 → E1).

Input: a long table ``(doc_id, head, q_pos, k_pos, token, weight)`` of last-layer attention
weights. The explanation of a document is the mean over heads of the weights from the first
query position, special tokens removed, the ``top_k`` largest kept (ties: earlier position).
All steps are keyed aggregations and a per-document window (≤ sequence length rows each). A table that is
dealt by document, as a table bucketed by ``doc_id`` is, is aggregated and ranked where it is, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def head_average(att: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Mean weight over heads from query position 0, per key position."""
    return (att.where(F.col("q_pos") == 0)
            .groupBy(doc_col, "k_pos", "token")
            .agg((F.sum("weight") / F.count(F.lit(1))).alias("score")))


def drop_special(df: DataFrame, token_col: str = "token", special=P.SPECIAL_TOKENS) -> DataFrame:
    """F7."""
    return df.where(~F.col(token_col).isin(list(special)))


def top_k_tokens(df: DataFrame, doc_col: str = "doc_id", top_k: int = P.TOP_K) -> DataFrame:
    """K1: rank by score desc, position asc (a stable sort keeps position order on ties)."""
    w = Window.partitionBy(doc_col).orderBy(F.col("score").desc(), F.col("k_pos"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def explain(att: DataFrame, doc_col: str = "doc_id", top_k: int = P.TOP_K) -> DataFrame:
    """Long form ``doc_id, rank, token, score``."""
    return top_k_tokens(drop_special(head_average(att, doc_col)), doc_col, top_k) \
        .select(doc_col, F.col("rank").cast("bigint").alias("rank"), "token", "score")


def explain_lists(att: DataFrame, doc_col: str = "doc_id", top_k: int = P.TOP_K) -> DataFrame:
    """E1 / J3 nested form: ``top_tokens = array<struct<token, score>>`` in rank order."""
    ranked = explain(att, doc_col, top_k)
    packed = F.sort_array(F.collect_list(F.struct("rank", "token", "score")))
    return ranked.groupBy(doc_col).agg(
        F.transform(packed, lambda x: F.struct(x["token"].alias("token"), x["score"].alias("score")))
        .alias("top_tokens"))
