"""Training in epochs (C1, C3, V5): logistic regression by mini-batch gradient descent over DataFrames.

A document is its label and a sparse vector: relative frequencies of its first tokens in
``num_features`` hash buckets, scaled to length 1, and a last feature that is always 1. The weights
are a table ``(idx, w)`` of ``num_features + 1`` rows, so their size is a parameter whatever the
corpus, and a step reads the documents where they lie: the weights go to the tasks as one broadcast
row, each document's margin is an array fold, and the gradient comes back as partial sums per
feature. A step is ``w - learning_rate * (mean gradient + weight_decay * w)``; the last feature
does not decay.

An epoch deals the training rows to ``ceil(rows / batch_size)`` batches by a hash of epoch and id,
takes a step with each, writes its weights to ``<path>/epoch=<n>`` and measures them on both parts.
The best epoch has the highest validation recall (ties: the earliest).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.hashing import hash_int
from ..session import materialize
from .features import explode_tokens

NUM_FEATURES = 1 << 14


def feature_index(token: Column, num_features: int = NUM_FEATURES) -> Column:
    """The hash bucket of a token."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % num_features).cast("int")


def hashed_features(df: DataFrame, text_col: str = "email_text", keep=("doc_id", "label"),
                    num_features: int = NUM_FEATURES, max_tokens: int = P.MAX_TOKENS) -> DataFrame:
    """``(*keep, features array<struct<idx, x>>)``; a row without tokens has the constant feature only.
    The first column of ``keep`` is the id."""
    toks = explode_tokens(df, text_col, keep, (), max_tokens, outer=True)
    counts = toks.groupBy(*keep, feature_index(F.col("token"), num_features).alias("idx")) \
        .agg(F.count("token").cast("double").alias("tf"))
    rows = counts.groupBy(*keep).agg(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "tf"))).alias("f"))
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, f: a + f["tf"] * f["tf"]))
    scaled = F.transform("f", lambda f: F.struct(f["idx"].alias("idx"), (f["tf"] / norm).alias("x")))
    constant = F.array(F.struct(F.lit(num_features).alias("idx"), F.lit(1.0).alias("x")))
    return rows.select(*keep, F.concat(scaled, constant).alias("features"))


def with_probability(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` with ``p``, the probability of class 1."""
    dense = F.transform(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda e: e["w"])
    vector = weights.agg(dense.alias("_w")).withColumn("_one", F.lit(1))        # one row of num_features + 1 numbers
    margin = F.aggregate("features", F.lit(0.0), lambda a, f: a + f["x"] * F.get(F.col("_w"), f["idx"]))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(vector), "_one") \
        .withColumn("p", 1 / (1 + F.exp(-margin))).drop("_one", "_w")


def step(batch: DataFrame, weights: DataFrame, n_rows: int, learning_rate: float, weight_decay: float,
         constant: int, label_col: str = "label") -> DataFrame:
    """The weights after one step with the ``n_rows`` rows of ``batch``; feature ``constant`` does not decay."""
    part = with_probability(batch, weights).select((F.col("p") - F.col(label_col)).alias("r"), F.explode("features").alias("f"))
    gradient = part.groupBy(F.col("f.idx").alias("idx")).agg(F.sum(F.col("r") * F.col("f.x")).alias("g"))
    decay = F.when(F.col("idx") < constant, F.lit(float(weight_decay)) * F.col("w")).otherwise(F.lit(0.0))
    return weights.join(gradient, "idx", "left").select(
        "idx", (F.col("w") - F.lit(float(learning_rate)) * (F.coalesce("g", F.lit(0.0)) / n_rows + decay)).alias("w"))


def measure(rows: DataFrame, weights: DataFrame, label_col: str = "label") -> dict:
    """Rows, mean log-loss and the classification metrics of ``rows``."""
    scored = with_probability(rows, weights).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    clipped = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.log(F.when(F.col(label_col) == 1, clipped).otherwise(1 - clipped))
    counted = scored.agg(F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("loss"),
                         *[F.count_if((F.col(label_col) == y) & (F.col("pred") == p)).alias(name)
                           for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]).first().asDict()
    right, positives = counted["tn"] + counted["tp"], counted["tp"] + counted["fn"]
    return {**counted, "accuracy": right / counted["rows"] if counted["rows"] else 0.0,
            "recall": counted["tp"] / positives if positives else 0.0}


@dataclass
class Fit:
    """The epochs in order, the best one's number and the folder of its weights."""
    history: list[dict]
    best_epoch: int
    best_path: str

    def weights(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.best_path)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(epoch, train_loss, val_loss, recall, accuracy, best)``, a row per epoch."""
        return spark.createDataFrame(
            [(h["epoch"], h["train_loss"], h["val_loss"], h["recall"], h["accuracy"], h["epoch"] == self.best_epoch)
             for h in self.history],
            "epoch bigint, train_loss double, val_loss double, recall double, accuracy double, best boolean")


def fit_epochs(train: DataFrame, val: DataFrame, path: str, epochs: int = 3, batch_size: int | None = None,
               learning_rate: float = 1.0, weight_decay: float = 0.01, text_col: str = "email_text",
               label_col: str = "label", id_col: str = "doc_id", num_features: int = NUM_FEATURES,
               max_tokens: int = P.MAX_TOKENS) -> Fit:
    """Fit ``epochs`` epochs. ``batch_size`` rows make a step (null: all rows, one step an epoch); a
    step is a Spark job, so on a large corpus it should be a large part of the rows."""
    spark = train.sparkSession
    keep = (id_col, label_col)
    data = materialize(hashed_features(train, text_col, keep, num_features, max_tokens), "epoch-rows")
    held = materialize(hashed_features(val, text_col, keep, num_features, max_tokens), "epoch-rows")
    n = data.count()
    if not n or epochs < 1:
        raise ValueError("training needs a row and an epoch")
    n_batches = -(-n // batch_size) if batch_size else 1
    weights = spark.range(num_features + 1).select(F.col("id").cast("int").alias("idx"), F.lit(0.0).alias("w"))
    history, best = [], None
    for epoch in range(1, epochs + 1):
        dealt = data.withColumn("_batch", hash_int(f"epoch{epoch}", id_col, "batch") % n_batches)
        sizes = {r["_batch"]: r["count"] for r in dealt.groupBy("_batch").count().collect()}
        for b in sorted(sizes):
            weights = materialize(step(dealt.where(F.col("_batch") == b), weights, sizes[b], learning_rate,
                                       weight_decay, num_features, label_col), "epoch-step")
        at = f"{path}/epoch={epoch}"
        weights.write.mode("overwrite").parquet(at)
        weights = spark.read.parquet(at)
        on_train, on_val = measure(data, weights, label_col), measure(held, weights, label_col)
        history.append({"epoch": epoch, "train_loss": on_train["loss"], "val_loss": on_val["loss"],
                        **{k: on_val[k] for k in ("recall", "accuracy", "tn", "fp", "fn", "tp")}})
        if best is None or on_val["recall"] > best[0]:
            best = (on_val["recall"], epoch, at)
    return Fit(history, best[1], best[2])


def predict_weights(df: DataFrame, weights: DataFrame, text_col: str = "email_text", id_col: str = "doc_id",
                    num_features: int = NUM_FEATURES, max_tokens: int = P.MAX_TOKENS) -> DataFrame:
    """``(id, p_1, pred)`` of texts with saved weights."""
    rows = with_probability(hashed_features(df, text_col, (id_col,), num_features, max_tokens), weights)
    return rows.select(id_col, F.col("p").alias("p_1"), (F.col("p") > 0.5).cast("int").alias("pred"))
