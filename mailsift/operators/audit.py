"""Data audits: ingest funnel, leakage, boilerplate, label-proxy tokens, refusals,
composition (A1–A8, F5, F6, F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import contains_any_ci

# FIXED VALUES: audit vocabularies.
LEAK_KEYWORDS = ("phishing",)
# word edges are spelled out (not ``\b``) so that every regex engine agrees on accents
_L, _R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
GREETING_PATTERN = r"(?i)" + _L + r"(hi|dear|hey|hello)" + _R
CLOSING_PATTERN = r"(?i)" + _L + r"(best regards|thanks|cheers|best)" + _R
NAME_PATTERN = _L + r"(John|Sarah|Michael|Emily|David|Lisa|James|Anna|Robert|Maria)" + _R
REFUSAL_PATTERN = (r"(?i)(i can't|i cannot|i can not|i'm sorry|i am sorry|as an ai|"
                   r"i'm not able|i am not able|i won't|no puedo|lo siento)")


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1: total, positives, negatives in one row (one pass, partial aggregation)."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col(label_col) == 1).alias("n_positive"),
                  F.count_if(F.col(label_col) == 0).alias("n_negative"))


def size_estimate(df: DataFrame, rows_per_minute: int = 200) -> DataFrame:
    """A3: the training-time rule of thumb, ``rows // 200`` minutes."""
    return df.agg(F.count(F.lit(1)).alias("rows")) \
        .withColumn("est_minutes", F.floor(F.col("rows") / F.lit(rows_per_minute)).cast("bigint"))


def composition(df: DataFrame, label_col: str = "label", source_col: str = "source") -> DataFrame:
    """Rows per class × source with sub-totals per class and a grand total (rollup)."""
    return df.rollup(label_col, source_col).agg(F.count(F.lit(1)).alias("n"))


def leakage_flag(text: Column | str, keywords=LEAK_KEYWORDS) -> Column:
    """T15 over a keyword list: does the lower-cased text reveal the label?"""
    return contains_any_ci(text, keywords)


def leakage_filter(df: DataFrame, text_col: str, keywords=LEAK_KEYWORDS) -> DataFrame:
    """drop rows whose text contains a label-revealing keyword."""
    return df.where(~leakage_flag(text_col, keywords))


def drop_source(df: DataFrame, rejected, source_col: str = "source") -> DataFrame:
    """discard every row of the listed provenances (pushed into the scan as NOT IN)."""
    return df.where(~F.col(source_col).isin(list(rejected)))


def leakage_rate(df: DataFrame, text_col: str, group_cols=("label",), keywords=LEAK_KEYWORDS) -> DataFrame:
    """A4: share of rows per group whose text contains a keyword."""
    flag = leakage_flag(text_col, keywords).cast("int")
    return (df.groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(flag).cast("bigint").alias("n_leaky"))
            .withColumn("leak_rate", F.round(F.col("n_leaky") / F.col("n"), 6)))


def boilerplate_flags(text: Column | str) -> dict[str, Column]:
    t = F.col(text) if isinstance(text, str) else text
    return {"greeting": t.rlike(GREETING_PATTERN), "closing": t.rlike(CLOSING_PATTERN),
            "names": t.rlike(NAME_PATTERN)}


def boilerplate_rate(df: DataFrame, text_col: str, group_cols=("label",)) -> DataFrame:
    """A5: share of rows with a formulaic greeting, closing, or stock name, and any of them."""
    fl = boilerplate_flags(text_col)
    anyf = fl["greeting"] | fl["closing"] | fl["names"]
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in {**fl, "any": anyf}.items():
        aggs.append(F.round(F.avg(c.cast("double")), 6).alias(f"{k}_rate"))
    return df.groupBy(*group_cols).agg(*aggs)


FRAMES = ("opening", "addressee", "closing", "signature")
#: Values of a frame that the sketch of frequent items follows, and those it may name.
FRAME_COUNTERS, FRAME_CANDIDATES = 20_000, 1_000


def frame_values(text: Column | str) -> dict[str, Column]:
    """The places of a message where formulas stand: the first word of its first line (lower case) and
    the capitalised word after it, its last line but one and its last line. Blank lines and a subject
    line at the top do not count; a message of fewer than three lines has no closing and no signature."""
    t = F.col(text) if isinstance(text, str) else text
    rows = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.filter(rows, lambda x, i: (i > 0) | ~x.startswith("Subject:"))
    first = F.get(rows, F.lit(0))
    from_end = lambda k: F.when(F.size(rows) >= 3, F.get(rows, F.size(rows) - k))
    return {"opening": F.lower(F.regexp_extract(first, r"^(\p{L}+)", 1)),
            "addressee": F.regexp_extract(first, r"^\p{L}+ (\p{Lu}\p{L}+)", 1),
            "closing": from_end(2), "signature": from_end(1)}


def frequent_frames(df: DataFrame, text_col: str, min_share: float = 0.02) -> DataFrame:
    """A5: ``(frame, value, n)``, the values that stand in one frame of at least ``min_share`` of all rows.

    Candidates come from a mergeable sketch of frequent items per frame: with ``FRAME_COUNTERS``
    counters it misses no value of the share asked for. The candidates, at most
    ``FRAME_CANDIDATES`` per frame, are then counted exactly."""
    if min_share * FRAME_CANDIDATES < 1:
        raise ValueError(f"min_share below 1/{FRAME_CANDIDATES} needs more candidates")
    total = df.count()
    values = _frame_rows(df, text_col)
    found = values.groupBy("frame").agg(F.expr(f"approx_top_k(value, {FRAME_CANDIDATES}, {FRAME_COUNTERS})").alias("top")) \
        .select("frame", F.explode("top").alias("e")).select("frame", F.col("e.item").alias("value"))
    exact = values.join(F.broadcast(found), ["frame", "value"]).groupBy("frame", "value").agg(F.count(F.lit(1)).alias("n"))
    return exact.where(F.col("n") >= F.lit(float(min_share)) * total)


def _frame_rows(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("frame"), v.alias("value")) for k, v in frame_values(text_col).items()])
    return df.select(*keep, F.inline(F.filter(entries, lambda e: F.coalesce(e["value"], F.lit("")) != "")))


def found_boilerplate_rate(df: DataFrame, text_col: str, group_cols=("label",), min_share: float = 0.02) -> DataFrame:
    """A5: share of rows per group with a frequent value in each frame, and in any, the frequent values being
    those found in ``df`` itself (:func:`frequent_frames`). Values are matched in the row, against
    the found ones as one small list per frame."""
    found = frequent_frames(df, text_col, min_share).select("frame", "value").collect()      # at most 1 / min_share a frame
    values = frame_values(text_col)
    flags = {k: F.coalesce(values[k].isin([r["value"] for r in found if r["frame"] == k]), F.lit(False)) for k in FRAMES}
    any_flag = flags["opening"] | flags["addressee"] | flags["closing"] | flags["signature"]
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"),
                                       *[F.round(F.avg(c.cast("double")), 6).alias(f"{k}_rate") for k, c in {**flags, "any": any_flag}.items()])


def refusal_flag(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return t.rlike(REFUSAL_PATTERN)


def refusal_filter(df: DataFrame, text_col: str) -> DataFrame:
    """F8: drop generated texts that read as a refusal."""
    return df.where(~refusal_flag(text_col))


def refusal_rate(df: DataFrame, text_col: str, generator_col: str = "generator") -> DataFrame:
    """Rejected ÷ sent per generator."""
    return (df.groupBy(generator_col)
            .agg(F.count(F.lit(1)).alias("sent"),
                 F.count_if(refusal_flag(text_col)).alias("refused"))
            .withColumn("refusal_rate", F.round(F.col("refused") / F.col("sent"), 6))
            .withColumn("valid", F.col("sent") - F.col("refused")))


def label_proxy_tokens(tokens: DataFrame, doc_col: str = "doc_id", label_col: str = "label",
                       token_col: str = "token", min_docs: int = 1, top_k: int = 10,
                       docs: DataFrame | None = None, distinct_rows: bool = False) -> DataFrame:
    """Tokens whose document frequency leans to one class (smoothed ratio), top-k per class.

    Input is one row per (document, token occurrence); ``docs`` (one row per document with
    at least one token) may be given to avoid deriving it from the tokens. Distinct (doc,
    token) first, then
    document frequency per (token, class) — both partial aggregations, so a token present
    in a third of all documents is reduced map-side.
    """
    if docs is None:  # documents with at least one token, per class
        docs = tokens.select(doc_col, label_col).distinct()
    n_cls = {r[0]: r[1] for r in docs.groupBy(label_col).agg(F.count(F.lit(1))).collect()}  # per class
    n_pos, n_neg = F.lit(n_cls.get(1, 0)), F.lit(n_cls.get(0, 0))
    pairs = tokens.select(doc_col, label_col, token_col)
    pairs = pairs if distinct_rows else pairs.distinct()
    dfreq = pairs.groupBy(token_col).agg(
        F.count_if(F.col(label_col) == 1).alias("df_pos"),
        F.count_if(F.col(label_col) == 0).alias("df_neg"))
    scored = (dfreq.where(F.col("df_pos") + F.col("df_neg") >= min_docs)
              .withColumn("pos_rate", (F.col("df_pos") + 1) / (n_pos + 2))
              .withColumn("neg_rate", (F.col("df_neg") + 1) / (n_neg + 2))
              .withColumn("lean", F.when(F.col("pos_rate") >= F.col("neg_rate"), F.lit(1)).otherwise(F.lit(0)))
              .withColumn("score", F.round(F.greatest(F.col("pos_rate") / F.col("neg_rate"),
                                                      F.col("neg_rate") / F.col("pos_rate")), 6)))
    w = Window.partitionBy("lean").orderBy(F.col("score").desc(), F.col(token_col))
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
            .select("lean", F.col("rank").cast("bigint").alias("rank"), token_col, "df_pos", "df_neg", "score"))


def funnel_outcome(body_len: Column, text_len: Column, min_body: int, min_text: int,
                   parsed: Column | None = None) -> Column:
    """A2 per row before dedup: the first failing test wins; ``parsed`` tells whether the message
    could be read at all."""
    readable = F.lit(True) if parsed is None else parsed
    return (F.when(~readable, F.lit("parse_error"))
            .when(body_len < min_body, F.lit("short_body"))
            .when(text_len < min_text, F.lit("short_text"))
            .otherwise(F.lit("passed")))


def ingest_funnel(df: DataFrame, body_col: str, text_col: str, fp_col: str,
                  min_body: int = P.MASKED_MIN_BODY, min_text: int = P.MIN_TEXT_LENGTH) -> DataFrame:
    """A2: found / short_body / short_text / duplicate / collected counts.

    One pass: rows are counted per (outcome, fingerprint) — partial aggregation, so a
    fingerprint copied a million times leaves each task as one row — and that table is
    reduced to rows and distinct fingerprints per outcome. Duplicates are ``rows −
    fingerprints`` of the rows that passed the length tests.
    """
    outcome = funnel_outcome(F.length(body_col), F.length(text_col), min_body, min_text)
    per_fp = (df.select(outcome.alias("_o"), F.when(outcome == "passed", F.col(fp_col)).alias("_fp"))
              .groupBy("_o", "_fp").agg(F.count(F.lit(1)).alias("_c")))
    per_o = per_fp.groupBy("_o").agg(F.sum("_c").cast("bigint").alias("rows"),
                                     F.count(F.lit(1)).cast("bigint").alias("groups"))
    one = per_o.agg(
        F.sum("rows").cast("bigint").alias("found"),
        F.sum(F.when(F.col("_o") == "short_body", F.col("rows"))).cast("bigint").alias("short_body"),
        F.sum(F.when(F.col("_o") == "short_text", F.col("rows"))).cast("bigint").alias("short_text"),
        F.sum(F.when(F.col("_o") == "passed", F.col("groups"))).cast("bigint").alias("collected"),
        F.sum(F.when(F.col("_o") == "passed", F.col("rows") - F.col("groups"))).cast("bigint").alias("duplicate"))
    long = one.select(F.expr("stack(5, 'found', found, 'short_body', short_body, 'short_text', short_text, "
                             "'collected', coalesce(collected, 0L), 'duplicate', coalesce(duplicate, 0L)) "
                             "as (outcome, n)"))
    # an outcome that no row reached is absent, as in a GROUP BY
    return long.where(F.col("n").isNotNull())
