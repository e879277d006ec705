"""Registered queries: the corpus-preparation flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sqltext as S
from .corpus import prepare_corpus
from .registry import register

CLEAN_LABELLED_SQL = f"""
WITH base AS (
  SELECT d.doc_id, CAST(l.toxic AS INTEGER) AS label, d.source,
         {S.clean_masked('d.text')} AS email_text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
kept AS (SELECT *, {S.fingerprint('email_text')} AS fp FROM base
         WHERE length(email_text) >= 30 AND length(email_text) >= 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, fp ORDER BY doc_id) AS rn FROM kept),
uniq AS (SELECT doc_id, label, source, email_text, fp FROM ranked WHERE rn = 1)"""

BALANCED_SQL = CLEAN_LABELLED_SQL + f""",
pos AS (SELECT count(*) AS n FROM uniq WHERE label = 1),
s AS (SELECT u.*, row_number() OVER (PARTITION BY label ORDER BY {S.hash_key('sample:42:', 'doc_id')}, doc_id) AS srn
      FROM uniq u),
bal AS (SELECT s.doc_id, s.label, s.source, s.email_text, s.fp FROM s, pos
        WHERE s.label = 1 OR s.srn <= CAST(floor(pos.n * CAST(1.0 AS DOUBLE)) AS BIGINT)),
sp AS (SELECT bal.*, row_number() OVER (ORDER BY {S.hash_key('split:42:', 'doc_id')}, doc_id) AS prn,
              count(*) OVER () AS tot FROM bal),
corpus AS (SELECT doc_id, label, source, email_text, fp,
                  CASE WHEN prn <= greatest(1, CAST(floor(tot * CAST(0.2 AS DOUBLE)) AS BIGINT))
                       THEN 'val' ELSE 'train' END AS part FROM sp)"""

FLAGSHIP_SQL = BALANCED_SQL + """
SELECT label, part, count(*) AS n FROM corpus GROUP BY label, part"""


@register("prepare_corpus_counts", FLAGSHIP_SQL)
def prepare_corpus_counts(spark, base):
    """Rows per (label, part) of the prepared corpus."""
    corpus = prepare_corpus(spark, base)
    return corpus.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


@register("prepared_corpus", BALANCED_SQL + """
SELECT doc_id, label, part, fp FROM corpus""")
def prepared_corpus(spark, base):
    """The prepared corpus itself (membership and part of every row)."""
    return prepare_corpus(spark, base).select("doc_id", "label", "part", "fp")
