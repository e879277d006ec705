"""Features (X1–X6): word tokens, vocabulary ids, truncation, padding and masks, TF-IDF.

The subword vocabulary of the original model is not available, so tokens are runs of
letters of the lower-cased text. Everything except the MLlib feature vector is a native
array expression or a keyed aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def tokens(text: Column | str) -> Column:
    """``array<string>`` of letter runs of the lower-cased text (whole text)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(P.TOKEN_PATTERN), F.lit(0))


def truncate_tokens(arr: Column | str, max_tokens: int = P.MAX_TOKENS) -> Column:
    """The first ``max_tokens`` tokens."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(a, 1, int(max_tokens))


def explode_tokens(df: DataFrame, text_col: str, id_cols=("doc_id",), keep=("label",),
                   max_tokens: int | None = None, outer: bool = False) -> DataFrame:
    """One row per (document, position, token); position is 0-based. ``outer=True`` keeps a
    document without tokens as one row with a null token."""
    arr = tokens(text_col)
    if max_tokens:
        arr = truncate_tokens(arr, max_tokens)
    gen = F.posexplode_outer(arr) if outer else F.posexplode(arr)
    return df.select(*id_cols, *[k for k in keep if k in df.columns], gen.alias("pos", "token"))


def doc_token_sets(df: DataFrame, text_col: str, id_cols=("doc_id",), keep=("label",)) -> DataFrame:
    """One row per (document, distinct token): the set is built inside the row
    (``array_distinct``), so document frequencies need no separate distinct shuffle."""
    return df.select(*id_cols, *[k for k in keep if k in df.columns],
                     F.explode(F.array_distinct(tokens(text_col))).alias("token"))


def vocabulary(token_rows: DataFrame, token_col: str = "token", min_df: int = 1,
               doc_col: str = "doc_id", distinct_rows: bool = False) -> DataFrame:
    """Token → dense id (from 1, by token order; 0 stays free for padding) with document frequency.
    ``distinct_rows=True`` when the input already has one row per (document, token), e.g.
    from :func:`doc_token_sets`.

    Frequencies come from a partial aggregation; ids are positions in token order computed
    by range partitions (no single-partition window).
    """
    from ..operators.ranking import global_position
    pairs = token_rows.select(doc_col, token_col)
    df_ = ((pairs if distinct_rows else pairs.distinct())
           .groupBy(token_col).agg(F.count(F.lit(1)).alias("doc_freq"))
           .where(F.col("doc_freq") >= min_df))
    pos = global_position(df_, token_col, token_col, "token_id")
    return pos.select(token_col, "token_id", "doc_freq")


def pad_and_mask(arr: Column | str, length: Column | int, pad_value=0) -> tuple[Column, Column]:
    """Pad an id array to ``length`` and the 1/0 attention mask."""
    a = F.col(arr) if isinstance(arr, str) else arr
    n = F.lit(length) if isinstance(length, int) else length
    padded = F.concat(a, F.array_repeat(F.lit(pad_value), F.greatest(n - F.size(a), F.lit(0))))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(a)), F.array_repeat(F.lit(0), F.greatest(n - F.size(a), F.lit(0))))
    return padded, mask


def truncation_report(df: DataFrame, text_col: str, max_tokens: int = P.MAX_TOKENS,
                      group_cols=()) -> DataFrame:
    """Rows, rows longer than the limit, and their share."""
    n = F.size(tokens(text_col))
    return (df.groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(n > max_tokens).alias("truncated"),
                 F.round(F.avg((n > max_tokens).cast("double")), 6).alias("truncated_share"),
                 F.max(n).cast("bigint").alias("max_tokens")))


def tfidf_weights(df: DataFrame, text_col: str, id_col: str = "doc_id", min_df: int = 1) -> DataFrame:
    """``(id, token_id, token, weight)``, the sparse vectors of whole texts by rows: term frequency times
    ``ln((N + 1) / (df + 1))``, at the token's position in the vocabulary (from 1). Frequent tokens
    are cut into pieces for the join with the vocabulary."""
    from ..session import materialize
    from ..sources.tables import dealt_by_key
    from .joins import heavy_of_counts, split_join
    n = df.count()
    vocab = materialize(vocabulary(doc_token_sets(df, text_col, (id_col,), ()), "token", min_df, id_col, distinct_rows=True), "vocabulary")
    idf = vocab.withColumn("idf", F.log((F.lit(float(n)) + 1) / (F.col("doc_freq") + 1)))
    dealt = dealt_by_key(df.select(id_col, text_col), id_col, n)        # texts are shuffled, not their tokens
    counts = explode_tokens(dealt, text_col, (id_col,), ()).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))
    heavy = heavy_of_counts(vocab, ["token"], "doc_freq")
    return split_join(counts, idf, ["token"], heavy, [id_col], "inner") \
        .select(id_col, "token_id", "token", (F.col("tf") * F.col("idf")).alias("weight"))


def sparse_vectors(weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, indices array<bigint>, values array<double>)`` by ascending position, from ``tfidf_weights``;
    a document without tokens has no row."""
    pairs = F.array_sort(F.collect_list(F.struct("token_id", "weight")))
    return weights.groupBy(id_col).agg(pairs.alias("_p")).select(
        id_col, F.transform("_p", lambda p: p["token_id"]).alias("indices"), F.transform("_p", lambda p: p["weight"]).alias("values"))


def tfidf_stages(text_col: str = "email_text", num_features: int = 1 << 18):
    """MLlib stages text → tokens → hashed term frequencies → IDF."""
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
    tok = RegexTokenizer(inputCol=text_col, outputCol="tokens", pattern=P.TOKEN_PATTERN, gaps=False,
                         toLowercase=True)
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    idf = IDF(inputCol="tf", outputCol="features")
    return [tok, tf, idf]
