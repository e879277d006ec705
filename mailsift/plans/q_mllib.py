"""Registered query: the MLlib pipeline (X6 C1(b) C3 S8) — rows-only check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators.mllib import select_by_recall, with_double_label
from ..session import scratch_path
from .corpus import prepare_corpus
from .registry import register


@register("logreg_metrics")
def logreg_metrics(spark, base):
    """TF-IDF + logistic regression fitted on the train part, best regularisation by
    validation recall, saved, loaded back, and evaluated on the validation part."""
    from pyspark.ml import PipelineModel
    corpus = prepare_corpus(spark, base, materialized=True)
    train, val = corpus.where(F.col("part") == "train"), corpus.where(F.col("part") == "val")
    reg, _, model = select_by_recall(train, val)
    path = scratch_path(spark, "lr-pipeline")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    pred = loaded.transform(with_double_label(val)).withColumn("pred", F.col("prediction").cast("int"))
    return V.classification_metrics(pred).withColumn("reg_param", F.lit(float(reg)))
