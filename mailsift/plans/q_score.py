"""Registered queries: scoring stored logits and evaluating them.

Stand-in logits: the first two components of ``embeddings.embedding``; the true class is
``label % 2`` and the original ``label`` serves as the threat category.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators.classify import predict
from ..sources.tables import read_table
from .registry import register

_PRED_SQL = """
WITH lg AS (SELECT vec_id, label AS category, label % 2 AS label,
                   CAST(embedding[1] AS DOUBLE) AS l0, CAST(embedding[2] AS DOUBLE) AS l1 FROM embeddings),
e AS (SELECT *, exp(l0 - greatest(l0, l1)) AS e0, exp(l1 - greatest(l0, l1)) AS e1 FROM lg),
p AS (SELECT vec_id, category, label, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM e),
pr AS (SELECT *, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS pred FROM p),
cm AS (SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
       FROM pr)"""


def scored(spark, base):
    emb = read_table(spark, base, "embeddings", "vec_id", "embedding", "label")
    lg = emb.select("vec_id", F.col("label").alias("category"), (F.col("label") % 2).alias("label"),
                    F.slice("embedding", 1, 2).cast("array<double>").alias("logits"))
    return predict(lg)


@register("softmax_scores", _PRED_SQL + """
SELECT vec_id, round(p0, 6) AS p_0, round(p1, 6) AS p_1 FROM pr""")
def softmax_scores(spark, base):
    """I1."""
    s = scored(spark, base)
    return s.select("vec_id", F.round(s.probs[0], 6).alias("p_0"), F.round(s.probs[1], 6).alias("p_1"))


@register("argmax_label", _PRED_SQL + """
SELECT vec_id, pred, CASE pred WHEN 0 THEN 'legitimate' ELSE 'phishing' END AS pred_label,
       round(greatest(p0, p1), 6) AS score FROM pr""")
def argmax_label(spark, base):
    """Winning class, its name and probability."""
    return scored(spark, base).select("vec_id", "pred", "pred_label", F.round("score", 6).alias("score"))


@register("positive_confidence", _PRED_SQL + """
SELECT vec_id, round(p1, 6) AS p_positive FROM pr""")
def positive_confidence(spark, base):
    """I4: P(class 1) whatever the winner."""
    return scored(spark, base).select("vec_id", F.round("p_positive", 6).alias("p_positive"))


@register("confusion_matrix", _PRED_SQL + " SELECT tn, fp, fn, tp FROM cm")
def confusion_matrix(spark, base):
    """V1."""
    return V.confusion(scored(spark, base))


_RATIO = "CASE WHEN ({d}) = 0 THEN 0.0 ELSE ({n}) / ({d}) END"
_METRICS_SQL = _PRED_SQL + f""",
mt AS (SELECT tn, fp, fn, tp,
              {_RATIO.format(n='tn + tp', d='tn + fp + fn + tp')} AS acc,
              {_RATIO.format(n='tp', d='tp + fp')} AS prec,
              {_RATIO.format(n='tp', d='tp + fn')} AS rec,
              {_RATIO.format(n='fp', d='fp + tn')} AS fpr0 FROM cm)
SELECT tn, fp, fn, tp, round(acc, 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall,
       round({_RATIO.format(n='2 * prec * rec', d='prec + rec')}, 6) AS f1, round(fpr0, 6) AS fpr,
       (round(acc, 6) = 1.0 AND round(prec, 6) = 1.0 AND round(rec, 6) = 1.0
        AND round({_RATIO.format(n='2 * prec * rec', d='prec + rec')}, 6) = 1.0) AS overfit_alarm
FROM mt"""


@register("classification_metrics", _METRICS_SQL)
def classification_metrics(spark, base):
    """V2 V3 V6: accuracy, precision, recall, F1, FPR and the perfect-score alarm."""
    return V.classification_metrics(scored(spark, base))


@register("fp_rate", _PRED_SQL + f"""
SELECT fp, tn, round({_RATIO.format(n='fp', d='fp + tn')}, 6) AS fpr FROM cm""")
def fp_rate(spark, base):
    """V3 against the 5–10 % limit."""
    return V.classification_metrics(scored(spark, base)).select("fp", "tn", "fpr")


@register("log_loss", _PRED_SQL + """
SELECT count(*) AS n, round(avg(-ln(greatest(least(CASE WHEN label = 1 THEN p1 ELSE p0 END, 1 - 1e-15), 1e-15))), 6)
       AS log_loss FROM pr""")
def log_loss(spark, base):
    """V5."""
    s = scored(spark, base)
    s = s.withColumn("p_true", F.when(F.col("label") == 1, s.probs[1]).otherwise(s.probs[0]))
    return V.log_loss(s, "label", "p_true")


@register("external_accuracy", _PRED_SQL + """
SELECT label, count(*) AS total, CAST(sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(sum(CASE WHEN label = pred THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM pr GROUP BY ROLLUP (label)""")
def external_accuracy(spark, base):
    """V4: accuracy per true class and overall."""
    return V.accuracy_by_class(scored(spark, base))


@register("recall_by_group", _PRED_SQL + f"""
SELECT category, count(*) FILTER (WHERE label = 1) AS positives,
       count(*) FILTER (WHERE label = 1 AND pred = 1) AS found,
       round({_RATIO.format(n='count(*) FILTER (WHERE label = 1 AND pred = 1)', d='count(*) FILTER (WHERE label = 1)')}, 6)
       AS recall FROM pr GROUP BY category""")
def recall_by_group(spark, base):
    """Which categories are missed."""
    return V.recall_by_group(scored(spark, base), "category")

