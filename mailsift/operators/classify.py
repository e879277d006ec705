"""Scoring (I1–I4, K2, J2) and a distributed multinomial naive Bayes.

Scores are array expressions (``transform``/``aggregate``), so a batch of logits is scored
inside whole-stage codegen. The naive Bayes model is a table ``(token, lp_0, lp_1)`` plus
class priors: fitting is two keyed aggregations, scoring is a join on ``token`` followed by a
per-document sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import materialize
from .features import explode_tokens
from .joins import heavy_of_counts, heavy_of_shares, split_join


def _label_map() -> Column:
    return F.create_map(*[x for k, v in P.LABEL_NAMES for x in (F.lit(k), F.lit(v))])


def softmax(logits: Column | str) -> Column:
    """Max-shifted softmax of an ``array<double>``."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(lg)
    e = F.transform(lg, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def argmax(arr: Column | str) -> Column:
    """K2: 0-based index of the largest element; the first one wins ties."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def label_name(idx: Column | str) -> Column:
    """Class id → name."""
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.element_at(_label_map(), i)


def predict(df: DataFrame, logits_col: str = "logits") -> DataFrame:
    """Probabilities, arg-max class, its name and score (the winning probability),
    and I4 the positive-class confidence."""
    out = df.withColumn("probs", softmax(logits_col))
    out = out.withColumn("pred", argmax("probs"))
    return (out.withColumn("pred_label", label_name("pred"))
            .withColumn("score", F.array_max("probs"))
            .withColumn("p_positive", F.element_at("probs", 2)))


# ---------------------------------------------------------------------------------------
# Multinomial naive Bayes
# ---------------------------------------------------------------------------------------

def doc_term_counts(df: DataFrame, text_col: str, id_col: str = "doc_id", label_col: str | None = "label",
                    max_tokens: int = P.MAX_TOKENS, outer: bool = False) -> DataFrame:
    """(doc, [label,] token, tf, first_pos): term counts of the first ``max_tokens`` tokens;
    with ``outer`` a document without tokens keeps one row (null token, tf 0)."""
    keep = (label_col,) if label_col else ()
    toks = explode_tokens(df, text_col, (id_col,), keep, max_tokens, outer)
    keys = [id_col, *([label_col] if label_col else []), "token"]
    return toks.groupBy(*keys).agg(F.count("token").alias("tf"), F.min("pos").alias("first_pos"))


def nb_grid(train: DataFrame, alphas, text_col: str = "email_text", label_col: str = "label",
            id_col: str = "doc_id", max_tokens: int = P.MAX_TOKENS) -> list[tuple[DataFrame, DataFrame]]:
    """C1 for several smoothings over one count of the tokens: ``(token_table, priors)`` per alpha.

    token_table: ``token, lp_0, lp_1`` with add-``alpha`` smoothing over the training
    vocabulary; priors: ``label, log_prior``. Token counts per class come from a partial
    aggregation (a token frequent in a third of the corpus is reduced map-side); the fit is
    eager: the per-token counts are written once to the checkpoint folder and the three
    totals (tokens per class, vocabulary size) come back as scalars.
    """
    tc = doc_term_counts(train, text_col, id_col, label_col, max_tokens)
    per_class = materialize(tc.groupBy("token").agg(
        F.sum(F.when(F.col(label_col) == 0, F.col("tf")).otherwise(0)).alias("c0"),
        F.sum(F.when(F.col(label_col) == 1, F.col("tf")).otherwise(0)).alias("c1")))
    t0, t1, v = per_class.agg(F.sum("c0"), F.sum("c1"), F.count(F.lit(1))).collect()[0]
    t0, t1, v = F.lit(float(t0 or 0)), F.lit(float(t1 or 0)), F.lit(float(v or 0))
    tables = [per_class.select("token", F.log((F.col("c0") + a) / (t0 + a * v)).alias("lp_0"),
                               F.log((F.col("c1") + a) / (t1 + a * v)).alias("lp_1"))
              for a in (F.lit(float(x)) for x in alphas)]
    counts = {r[0]: r[1] for r in train.groupBy(label_col).agg(F.count(F.lit(1))).collect()}
    if len(counts) < 2:     # an absent class gets a smoothed prior instead of none
        counts = {k: counts.get(k, 0) + 1 for k in (0, 1)}
    n_all = float(sum(counts.values()))
    spark = train.sparkSession
    priors = spark.createDataFrame([(int(k), float(n)) for k, n in sorted(counts.items())], "label int, n double") \
        .select("label", F.log(F.col("n") / F.lit(n_all)).alias("log_prior"))
    return [(table, priors) for table in tables]


def nb_fit(train: DataFrame, text_col: str = "email_text", label_col: str = "label",
           alpha: float = 1.0, id_col: str = "doc_id", max_tokens: int = P.MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """``(token_table, priors)`` for one smoothing."""
    return nb_grid(train, [alpha], text_col, label_col, id_col, max_tokens)[0]


def nb_log_scores(docs: DataFrame, table: DataFrame, priors: DataFrame, text_col: str = "email_text",
                  id_col: str = "doc_id", max_tokens: int = P.MAX_TOKENS) -> DataFrame:
    """Per document: ``s0, s1`` = log prior + Σ tf · log P(token | class) over known tokens.

    Documents are exploded with ``posexplode_outer`` (a document without tokens keeps a null-token
    row), term counts are joined to the model with a left join (unknown tokens contribute nothing),
    the frequent tokens cut into pieces, and summed per document.
    """
    tc = doc_term_counts(docs, text_col, id_col, None, max_tokens, outer=True)
    # a token's probability under the model is its share of the rows to expect
    heavy = heavy_of_shares(table.select("token", F.exp(F.greatest("lp_0", "lp_1")).alias("share")), ["token"], "share")
    joined = split_join(tc, table, ["token"], heavy, [id_col])
    sums = joined.groupBy(id_col).agg(F.sum(F.col("tf") * F.col("lp_0")).alias("_s0"),
                                      F.sum(F.col("tf") * F.col("lp_1")).alias("_s1"))
    lp = {r["label"]: r["log_prior"] for r in priors.collect()}  # one row per class
    return sums.select(id_col, (F.lit(lp.get(0)) + F.coalesce(F.col("_s0"), F.lit(0.0))).alias("s0"),
                       (F.lit(lp.get(1)) + F.coalesce(F.col("_s1"), F.lit(0.0))).alias("s1"))


def nb_predict(docs: DataFrame, table: DataFrame, priors: DataFrame, text_col: str = "email_text",
               id_col: str = "doc_id", max_tokens: int = P.MAX_TOKENS) -> DataFrame:
    """I3 over C1: ``p_0, p_1, pred, pred_label, score`` per document."""
    s = nb_log_scores(docs, table, priors, text_col, id_col, max_tokens)
    scored = predict(s.withColumn("logits", F.array("s0", "s1")))
    return scored.select(id_col, F.col("probs")[0].alias("p_0"), F.col("probs")[1].alias("p_1"),
                         "pred", "pred_label", "score")


def nb_leave_one_out(docs: DataFrame, group_col: str = "source", text_col: str = "email_text", label_col: str = "label",
                     id_col: str = "doc_id", alpha: float = 1.0, max_tokens: int = P.MAX_TOKENS) -> DataFrame:
    """P5 + C1: every document scored by the model of all *other* groups: ``(id, group, label, p_1, pred)``.

    The tokens are counted once per (group, token, class). A group's model is the total less its own
    counts, so no group is counted again and no model is fitted twice; a token that only the group
    has is unknown to it, as it would be to a model that never saw the group.
    """
    toks = explode_tokens(docs, text_col, (id_col, group_col, label_col), (), max_tokens, outer=True)
    tc = materialize(toks.groupBy(id_col, group_col, label_col, "token").agg(F.count("token").alias("tf")), "loo-counts")
    of = lambda y: F.sum(F.when(F.col(label_col) == y, F.col("tf")).otherwise(0))
    own = materialize(tc.where(F.col("token").isNotNull()).groupBy(group_col, "token").agg(
        of(0).alias("c0"), of(1).alias("c1"), F.count(F.lit(1)).alias("n_docs")), "loo-own")
    total = own.groupBy("token").agg(F.sum("c0").alias("a0"), F.sum("c1").alias("a1"), F.count(F.lit(1)).alias("n_groups"))
    heavy = heavy_of_counts(total.select("token", "n_groups"), ["token"], "n_groups")
    rest = materialize(split_join(own, total, ["token"], heavy, [group_col], "inner").select(
        group_col, "token", "n_docs", "c0", "c1", (F.col("a0") - F.col("c0")).alias("r0"), (F.col("a1") - F.col("c1")).alias("r1")), "loo-rest")
    all0, all1, v = total.agg(F.sum("a0"), F.sum("a1"), F.count(F.lit(1))).first()
    n_of = {y: n for y, n in docs.groupBy(label_col).count().collect()}         # one row per class
    rows_per = docs.groupBy(group_col).agg(F.count_if(F.col(label_col) == 0).alias("n0"), F.count_if(F.col(label_col) == 1).alias("n1"))
    sums = rest.groupBy(group_col).agg(F.sum("c0").alias("g0"), F.sum("c1").alias("g1"),
                                       F.count_if(F.col("r0") + F.col("r1") == 0).alias("only_here"))
    left0, left1 = F.lit(n_of.get(0, 0)) - F.col("n0"), F.lit(n_of.get(1, 0)) - F.col("n1")
    gap = F.when((left0 == 0) | (left1 == 0), 1).otherwise(0)           # an absent class gets a smoothed prior
    groups = rows_per.join(sums, group_col, "left").select(
        group_col, *[F.log((left + gap) / (left0 + left1 + 2 * gap)).alias(f"prior{y}") for y, left in ((0, left0), (1, left1))],
        *[(F.lit(float(a or 0)) - F.coalesce(f"g{y}", F.lit(0)) + alpha * (F.lit(float(v)) - F.coalesce("only_here", F.lit(0)))).alias(f"t{y}")
          for y, a in ((0, all0), (1, all1))])
    heavy = heavy_of_counts(rest, [group_col, "token"], "n_docs")
    known = rest.where(F.col("r0") + F.col("r1") > 0).select(group_col, "token", "r0", "r1", F.lit(True).alias("known"))
    joined = split_join(tc, known, [group_col, "token"], heavy, [id_col])
    per_doc = joined.groupBy(id_col, group_col, label_col).agg(
        *[F.sum(F.when(F.col("known"), F.col("tf") * F.log(F.col(f"r{y}") + alpha))).alias(f"l{y}") for y in (0, 1)],
        F.sum(F.when(F.col("known"), F.col("tf")).otherwise(0)).alias("n_known"))
    scored = per_doc.join(groups, group_col).withColumn("logits", F.array(*[
        F.col(f"prior{y}") + F.coalesce(f"l{y}", F.lit(0.0)) - F.col("n_known") * F.log(F.col(f"t{y}")) for y in (0, 1)]))
    return predict(scored).select(id_col, group_col, label_col, F.col("p_positive").alias("p_1"), "pred")


def nb_explain(docs: DataFrame, table: DataFrame, text_col: str = "email_text", id_col: str = "doc_id",
               top_k: int = P.TOP_K, max_tokens: int = P.MAX_TOKENS) -> DataFrame:
    """E1 over C1: each token's contribution ``tf · (lp_1 − lp_0)`` toward the positive
    class; the ``top_k`` largest per document (ties: earlier first occurrence first)."""
    from pyspark.sql import Window
    tc = doc_term_counts(docs, text_col, id_col, None, max_tokens)
    contrib = tc.join(table, "token").select(
        id_col, "token", "first_pos", (F.col("tf") * (F.col("lp_1") - F.col("lp_0"))).alias("contribution"))
    w = Window.partitionBy(id_col).orderBy(F.col("contribution").desc(), F.col("first_pos"))
    return (contrib.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
            .select(id_col, F.col("rank").cast("bigint").alias("rank"), "token",
                    F.round("contribution", 6).alias("contribution")))


def save_model(table: DataFrame, priors: DataFrame, path: str) -> None:
    """Persist the model as two Parquet tables."""
    table.write.mode("overwrite").parquet(f"{path}/tokens")
    priors.write.mode("overwrite").parquet(f"{path}/priors")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/priors")


def score_texts(spark: SparkSession, texts, table: DataFrame, priors: DataFrame) -> DataFrame:
    """I2 / I3 for ad-hoc messages: the same scoring job over a small DataFrame of texts
    (order kept through ``doc_id`` = position)."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, email_text string")
    return nb_predict(df, table, priors).orderBy("doc_id")
