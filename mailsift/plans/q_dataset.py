"""Registered queries: dedup, limits, sampling, splits, unions, sources and audits
(D1 D2 L1–L3 P1–P5 U1 S5–S7 F5 F6 F8 A1–A4 A6–A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.hashing import hash_key
from ..functions.text import clean_masked, fingerprint
from ..operators import audit as A
from ..operators.compute import with_computed
from ..operators.dedup import dedup_keep_first, duplicate_accounting
from ..operators.features import doc_token_sets, tokens
from ..operators.ranking import global_position
from ..operators.sample import (cap_rows, class_balance, exact_n_sample, first_per_class,
                                holdout_by_source, positive_cap, train_val_split)
from ..session import materialize
from ..sources.tables import documents, labelled_documents, read_table
from . import sqltext as S
from .corpus import clean_labelled, prepare_corpus
from .q_corpus import BALANCED_SQL, CLEAN_LABELLED_SQL
from .registry import register

FP_DOCS_SQL = f"(SELECT doc_id, lang, {S.fingerprint('text')} AS fp FROM documents)"


@register("dedup_keep_first", f"SELECT min(doc_id) AS doc_id, fp FROM {FP_DOCS_SQL} t GROUP BY fp")
def dedup_keep_first_q(spark, base):
    """D1 over all documents: first (lowest id) row per fingerprint."""
    d = documents(spark, base, "doc_id", "text").withColumn("fp", fingerprint("text"))
    return dedup_keep_first(d, "fp", "doc_id").select("doc_id", "fp")


@register("dup_accounting", f"""
SELECT lang, count(*) AS n_rows, count(DISTINCT fp) AS n_distinct,
       count(*) - count(DISTINCT fp) AS n_duplicates FROM {FP_DOCS_SQL} t GROUP BY lang""")
def dup_accounting(spark, base):
    """D2 per language."""
    d = documents(spark, base, "doc_id", "lang", "text").withColumn("fp", fingerprint("text"))
    return duplicate_accounting(d, "fp", scope=("lang",))


_FUNNEL_BASE = f"""
WITH b AS (SELECT doc_id, {S.clean_masked('text')} AS body FROM documents),
t AS (SELECT *, CASE WHEN length(body) < 30 THEN 'short_body' WHEN length(body) < 50 THEN 'short_text'
                     ELSE 'passed' END AS o, {S.fingerprint('body')} AS fp FROM b)"""


FUNNEL_SQL = _FUNNEL_BASE + """
SELECT 'found' AS outcome, count(*) AS n FROM t
UNION ALL SELECT o AS outcome, count(*) AS n FROM t WHERE o <> 'passed' GROUP BY o
UNION ALL SELECT 'collected' AS outcome, count(DISTINCT fp) AS n FROM t WHERE o = 'passed'
UNION ALL SELECT 'duplicate' AS outcome, count(*) - count(DISTINCT fp) AS n FROM t WHERE o = 'passed'"""


@register("ingest_funnel", FUNNEL_SQL)
def ingest_funnel(spark, base):
    """A2 F1 F2 over every document (masked profile, no subject)."""
    d = with_computed(documents(spark, base, "doc_id", "text"), body=clean_masked("text"))
    d = d.withColumn("fp", fingerprint("body"))
    return A.ingest_funnel(d, "body", "body", "fp")


@register("capped_positives", CLEAN_LABELLED_SQL + f"""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {S.hash_key('cap:42:', 'doc_id')}, doc_id) AS rn
                    FROM uniq WHERE label = 1) c
WHERE rn <= {positive_cap(60, 1.0)}""")
def capped_positives(spark, base):
    """L1 L2: positives capped at max_samples // 2 (balance 1.0, max_samples 60)."""
    rows = clean_labelled(spark, base).where(F.col("label") == 1)
    unique = materialize(dedup_keep_first(rows, "fp", "doc_id", scope=("label",)))
    return cap_rows(unique, positive_cap(60, 1.0), "doc_id").select("doc_id")


@register("seeded_shuffle", f"""
SELECT doc_id, row_number() OVER (ORDER BY {S.hash_key('shuffle:42:', 'doc_id')}, doc_id) AS pos FROM documents""")
def seeded_shuffle(spark, base):
    """Position of every document in the seeded order (bucketed, no global window)."""
    d = documents(spark, base, "doc_id").withColumn("_k", hash_key("shuffle", "doc_id"))
    return global_position(d, "_k", "doc_id", "pos").select("doc_id", "pos")


@register("exact_n_sample", f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
       ORDER BY {S.hash_key('sample:42:', 'doc_id')}, doc_id) AS rn FROM documents) s WHERE rn <= 50""")
def exact_n_sample_q(spark, base):
    """Exactly 50 documents per language (seeded)."""
    d = documents(spark, base, "doc_id", "lang")
    return exact_n_sample(d, 50, "doc_id", partition_cols=("lang",)).select("doc_id", "lang")


@register("class_balance", CLEAN_LABELLED_SQL + f""",
pos AS (SELECT count(*) AS n FROM uniq WHERE label = 1),
s AS (SELECT u.*, row_number() OVER (PARTITION BY label ORDER BY {S.hash_key('sample:42:', 'doc_id')}, doc_id) AS srn
      FROM uniq u)
SELECT s.doc_id, s.label FROM s, pos WHERE s.label = 1 OR s.srn <= CAST(floor(pos.n * CAST(0.5 AS DOUBLE)) AS BIGINT)""")
def class_balance_q(spark, base):
    """P3 with balance ratio 0.5: all positives, int(0.5 × positives) negatives."""
    rows = clean_labelled(spark, base)
    unique = materialize(dedup_keep_first(rows, "fp", "doc_id", scope=("label",)))
    return class_balance(unique, "doc_id", 0.5).select("doc_id", "label")


@register("train_val_split", f"""
SELECT doc_id, label, CASE WHEN rn <= greatest(1, CAST(floor(tot * CAST(0.2 AS DOUBLE)) AS BIGINT)) THEN 'val'
                            ELSE 'train' END AS part
FROM (SELECT d.doc_id, CAST(l.toxic AS INTEGER) AS label,
             row_number() OVER (ORDER BY {S.hash_key('split:42:', 'd.doc_id')}, d.doc_id) AS rn,
             count(*) OVER () AS tot
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) s""")
def train_val_split_q(spark, base):
    """P4 over every labelled document."""
    ld = labelled_documents(spark, base).select("doc_id", "label")
    return train_val_split(ld, "doc_id", 0.2)


@register("holdout_by_source", """
SELECT d.doc_id, CASE WHEN d.source IN ('src0', 'src1') THEN 'test' ELSE 'train' END AS part
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def holdout_by_source_q(spark, base):
    """P5: rows from sources src0/src1 are held out for evaluation."""
    ld = labelled_documents(spark, base).select("doc_id", "source")
    return holdout_by_source(ld, ("src0", "src1")).select("doc_id", "part")


@register("first_per_class", BALANCED_SQL + f"""
SELECT label, arg_min(email_text, {S.hash_key('shuffle:42:', 'doc_id')}) AS email_text FROM corpus GROUP BY label""")
def first_per_class_q(spark, base):
    """L3: first positive and first negative of the shuffled prepared corpus."""
    corpus = prepare_corpus(spark, base).withColumn("_o", hash_key("shuffle", "doc_id"))
    return first_per_class(corpus, "email_text", "_o")


@register("combine_classes", """
SELECT 'd' || CAST(d.doc_id AS VARCHAR) AS row_id, 1 AS label, d.source AS source
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1
UNION ALL
SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS row_id, 0 AS label,
       'conversations' AS source FROM conversations WHERE role = 'assistant'""")
def combine_classes(spark, base):
    """Positives from labelled documents + negatives from assistant turns (UNION ALL)."""
    pos = (labelled_documents(spark, base).where(F.col("label") == 1)
           .select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"),
                   F.lit(1).alias("label"), "source"))
    conv = read_table(spark, base, "conversations", "conv_id", "turn", "role")
    neg = (conv.where(F.col("role") == "assistant")
           .select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"),
                            F.col("turn").cast("string")).alias("row_id"),
                   F.lit(0).alias("label"), F.lit("conversations").alias("source")))
    return pos.unionByName(neg)


_LABELLED = "(SELECT d.doc_id, d.text, d.source, CAST(l.toxic AS INTEGER) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@register("class_counts", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS n_positive,
       count(*) FILTER (WHERE label = 0) AS n_negative FROM {_LABELLED} t""")
def class_counts(spark, base):
    """A1."""
    return A.class_counts(labelled_documents(spark, base).select("label"))


@register("composition_rollup", f"""
SELECT label, source, count(*) AS n FROM {_LABELLED} t GROUP BY ROLLUP (label, source)""")
def composition_rollup(spark, base):
    """Class × source with sub-totals."""
    return A.composition(labelled_documents(spark, base).select("label", "source"))


@register("size_estimate", BALANCED_SQL + """
SELECT count(*) AS rows, CAST(floor(count(*) / 200) AS BIGINT) AS est_minutes FROM corpus""")
def size_estimate(spark, base):
    """A3 over the prepared corpus."""
    return A.size_estimate(prepare_corpus(spark, base))


# FIXED VALUES: the label word of the reference audit plus two frequent function words of
# the corpus, so that the filter has rows to act on.
AUDIT_KEYWORDS = ("phishing", "und", "que")
_KW_SQL = " OR ".join(f"contains(lower(text), '{k}')" for k in AUDIT_KEYWORDS)


@register("leakage_filter", f"SELECT doc_id FROM {_LABELLED} t WHERE NOT ({_KW_SQL})")
def leakage_filter(spark, base):
    """F5."""
    ld = labelled_documents(spark, base).select("doc_id", "text")
    return A.leakage_filter(ld, "text", AUDIT_KEYWORDS).select("doc_id")


@register("leakage_rate", f"""
SELECT label, count(*) AS n, CAST(sum(CASE WHEN {_KW_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS n_leaky,
       round(sum(CASE WHEN {_KW_SQL} THEN 1 ELSE 0 END) / count(*), 6) AS leak_rate
FROM {_LABELLED} t GROUP BY label""")
def leakage_rate(spark, base):
    """A4 per class."""
    ld = labelled_documents(spark, base).select("label", "text")
    return A.leakage_rate(ld, "text", ("label",), AUDIT_KEYWORDS)


@register("drop_source", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src3')")
def drop_source(spark, base):
    """a rejected provenance is removed (predicate reaches the Parquet scan)."""
    return A.drop_source(documents(spark, base, "doc_id", "source"), ("src3",))


@register("label_source", "SELECT doc_id, 1 AS label, 'documents' AS source FROM documents")
def label_source(spark, base):
    """One constant label ∈ {0, 1} and a provenance for a whole source."""
    from ..sources.labelled import label_whole_source
    return label_whole_source(documents(spark, base, "doc_id"), 1, "documents")


@register("class_subset", """
SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality * 2 + l.toxic = 0""")
def class_subset(spark, base):
    """Class 0 of the four-class view ``quality*2 + toxic``."""
    lab = read_table(spark, base, "labels", "doc_id", "quality", "toxic")
    four = lab.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label4"))
    return (documents(spark, base, "doc_id").join(four.where(F.col("label4") == 0), "doc_id")
            .select("doc_id"))


@register("label_proxy_tokens", f"""
WITH tok0 AS (SELECT d.doc_id, CAST(l.toxic AS INTEGER) AS label,
                     unnest(regexp_extract_all(lower(d.text), '{P.TOKEN_PATTERN}')) AS token
              FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tok AS (SELECT DISTINCT doc_id, label, token FROM tok0),
docs AS (SELECT DISTINCT doc_id, label FROM tok),
n AS (SELECT max(CASE WHEN label = 1 THEN c END) AS n_pos, max(CASE WHEN label = 0 THEN c END) AS n_neg
      FROM (SELECT label, count(*) AS c FROM docs GROUP BY label) x),
dfreq AS (SELECT token, count(*) FILTER (WHERE label = 1) AS df_pos, count(*) FILTER (WHERE label = 0) AS df_neg
          FROM tok GROUP BY token),
sc AS (SELECT token, df_pos, df_neg, (df_pos + 1) / (n_pos + 2) AS pos_rate, (df_neg + 1) / (n_neg + 2) AS neg_rate
       FROM dfreq, n WHERE df_pos + df_neg >= 1),
sc2 AS (SELECT *, CASE WHEN pos_rate >= neg_rate THEN 1 ELSE 0 END AS lean,
               round(greatest(pos_rate / neg_rate, neg_rate / pos_rate), 6) AS score FROM sc)
SELECT lean, rank, token, df_pos, df_neg, score FROM
  (SELECT *, row_number() OVER (PARTITION BY lean ORDER BY score DESC, token) AS rank FROM sc2) r
WHERE rank <= 10""")
def label_proxy_tokens(spark, base):
    """The tokens that best separate the classes (top 10 per leaning class)."""
    ld = labelled_documents(spark, base).select("doc_id", "label", "text")
    docs = ld.where(F.size(tokens("text")) > 0).select("doc_id", "label")
    return A.label_proxy_tokens(doc_token_sets(ld, "text"), docs=docs, distinct_rows=True)


_GEN = "'gen' || CAST(conv_id % 2 AS VARCHAR)"


@register("refusal_rate", f"""
SELECT {_GEN} AS generator, count(*) AS sent,
       count(*) FILTER (WHERE regexp_matches(text, {S.lit(A.REFUSAL_PATTERN)})) AS refused,
       round(count(*) FILTER (WHERE regexp_matches(text, {S.lit(A.REFUSAL_PATTERN)})) / count(*), 6) AS refusal_rate,
       count(*) - count(*) FILTER (WHERE regexp_matches(text, {S.lit(A.REFUSAL_PATTERN)})) AS valid
FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def refusal_rate(spark, base):
    """Refused ÷ sent per generator (assistant turns; generator = conversation parity)."""
    conv = read_table(spark, base, "conversations", "conv_id", "role", "text", parallel=True)
    gen = conv.where(F.col("role") == "assistant").withColumn(
        "generator", F.concat(F.lit("gen"), (F.col("conv_id") % 2).cast("string")))
    return A.refusal_rate(gen, "text")


@register("refusal_filter", f"""
SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND NOT regexp_matches(text, {S.lit(A.REFUSAL_PATTERN)})""")
def refusal_filter(spark, base):
    """F8."""
    conv = read_table(spark, base, "conversations", "conv_id", "turn", "role", "text", parallel=True)
    return A.refusal_filter(conv.where(F.col("role") == "assistant"), "text").select("conv_id", "turn")
