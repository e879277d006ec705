"""Evaluation (V1–V6, E2): confusion matrix, recall-first metrics, false-positive rate,
log-loss, per-class accuracy and per-group recall — one partial aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 when the denominator is 0 (``zero_division=0``)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "pred", group_cols=()) -> DataFrame:
    """V1: ``tn fp fn tp`` (rows = true class 0/1, columns = predicted 0/1); missing cells 0."""
    y, p = F.col(label_col), F.col(pred_col)
    return df.groupBy(*group_cols).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def metrics_from_confusion(conf: DataFrame, digits: int = 6) -> DataFrame:
    """V2 V3 V6: accuracy, precision, recall, F1 (positive class 1), FPR and the alarm that
    flags a perfect score as suspicious."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    out = (conf.withColumn("accuracy", F.round(_ratio(tn + tp, n), digits))
           .withColumn("precision", F.round(precision, digits))
           .withColumn("recall", F.round(recall, digits))
           .withColumn("f1", F.round(_ratio(2 * precision * recall, precision + recall), digits))
           .withColumn("fpr", F.round(_ratio(fp, fp + tn), digits)))
    return out.withColumn("overfit_alarm", (F.col("accuracy") == 1.0) & (F.col("precision") == 1.0)
                          & (F.col("recall") == 1.0) & (F.col("f1") == 1.0))


def classification_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
                           group_cols=()) -> DataFrame:
    return metrics_from_confusion(confusion(df, label_col, pred_col, group_cols))


def log_loss(df: DataFrame, label_col: str, prob_true_col: str, group_cols=(), eps: float = 1e-15) -> DataFrame:
    """V5: mean cross-entropy ``-ln p(true class)`` (clipped at ``eps``)."""
    p = F.greatest(F.least(F.col(prob_true_col), F.lit(1 - eps)), F.lit(eps))
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.avg(-F.log(p)), 6).alias("log_loss"))


def accuracy_by_class(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """V4: correct ÷ total per true class and overall (rollup; overall has a null label)."""
    correct = (F.col(label_col) == F.col(pred_col)).cast("int")
    return (df.rollup(label_col)
            .agg(F.count(F.lit(1)).alias("total"), F.sum(correct).cast("bigint").alias("correct"))
            .withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6)))


def recall_by_group(df: DataFrame, group_col: str, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Per group (threat type, language, source…), positives, found and recall."""
    y, p = F.col(label_col), F.col(pred_col)
    return (df.groupBy(group_col)
            .agg(F.count_if(y == 1).alias("positives"), F.count_if((y == 1) & (p == 1)).alias("found"))
            .withColumn("recall", F.round(_ratio(F.col("found"), F.col("positives")), 6)))
