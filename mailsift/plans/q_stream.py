"""Registered queries: streaming jobs over the documents table arriving as files.
Each is checked against the batch answer of the same operator."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.text import clean_masked, fingerprint
from ..operators.classify import nb_fit
from ..operators.compute import with_computed
from ..operators.rules import KEYWORD_RULES
from ..session import scratch_path
from ..sources.eml import FOLDERS, stream_messages, write_messages
from ..sources.tables import documents
from ..streaming import jobs as W
from . import sqltext as S
from .corpus import prepare_corpus
from .q_dataset import FUNNEL_SQL
from .q_mime import INGEST_SQL, clean_messages, ingest, message_fixture
from .q_model import _nb_sql
from .registry import register


def _staged(spark, base):
    """The documents as arriving files; a micro-batch takes four for each task slot."""
    d = documents(spark, base, "doc_id", "text")
    path = W.stage_files(d, scratch_path(spark, "stream-src"))
    return W.read_stream(spark, path, d.schema, 4 * spark.sparkContext.defaultParallelism)


@register("stream_score", _nb_sql(1.0) + f""",
dd AS (SELECT doc_id, {S.clean_masked('text')} AS email_text FROM documents),
dtok AS (SELECT doc_id, unnest(regexp_extract_all(lower(email_text), '{P.TOKEN_PATTERN}')[1:{P.MAX_TOKENS}]) AS token
         FROM dd),
dtf AS (SELECT doc_id, token, count(*) AS tf FROM dtok GROUP BY doc_id, token),
dsum AS (SELECT doc_id, sum(tf * lp_0) AS s0, sum(tf * lp_1) AS s1 FROM dtf JOIN model USING (token) GROUP BY doc_id),
dsc AS (SELECT dd.doc_id, pr0 + coalesce(s0, 0.0) AS s0, pr1 + coalesce(s1, 0.0) AS s1 FROM dd LEFT JOIN dsum USING (doc_id), pri),
dp AS (SELECT doc_id, exp(s1 - greatest(s0, s1)) / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))) AS p1 FROM dsc)
SELECT dd.doc_id, dd.email_text, {S.fingerprint('dd.email_text')} AS fp,
       ({" OR ".join(f"regexp_matches(dd.email_text, {S.lit(p)})" for _, p in KEYWORD_RULES)}) AS flagged,
       round(dp.p1, 6) AS p_1, CASE WHEN dp.p1 > 1 - dp.p1 THEN 1 ELSE 0 END AS pred
FROM dd JOIN dp USING (doc_id)""")
def stream_score(spark, base):
    """Continuous clean + fingerprint + rule flag + classifier score over a file stream
    (model fitted on the prepared corpus; each micro-batch scored via foreachBatch)."""
    from pyspark.sql import functions as F
    corpus = prepare_corpus(spark, base)
    table, priors = nb_fit(corpus.where(F.col("part") == "train"), "email_text", "label", 1.0)
    sink = W.score_batches(W.clean_and_score(_staged(spark, base)), table, priors, "stream-score")
    out = spark.read.parquet(sink)
    return out.select("doc_id", "email_text", "fp", "flagged", F.round("p_1", 6).alias("p_1"), "pred")


@register("stream_dedup", f"SELECT min(doc_id) AS doc_id, {S.fingerprint('text')} AS fp FROM documents GROUP BY 2")
def stream_dedup(spark, base):
    """The rows that cross-batch deduplication keeps (= batch D1's)."""
    s = _staged(spark, base).select("doc_id", fingerprint("text").alias("fp"))
    return W.survivors(spark, W.dedup_batches(s, "stream-dedup")).select("doc_id", "fp")


@register("stream_funnel", FUNNEL_SQL)
def stream_funnel(spark, base):
    """The funnel after all files, duplicates included (= batch A2's)."""
    from pyspark.sql import functions as F
    staged = with_computed(_staged(spark, base), body=clean_masked("text"))
    rows = staged.select("body", fingerprint("body").alias("fp"))
    return W.funnel_so_far(spark, W.running_funnel(rows, "stream-funnel", "body", "body", "fp")).select(
        "outcome", F.col("n").cast("bigint").alias("n"))


@register("stream_ingest", INGEST_SQL)
def stream_ingest(spark, base):
    """W1 from message files: the files arrive, are parsed, chosen and cleaned (= batch ingest's rows)."""
    root = scratch_path(spark, "stream-messages")
    n = write_messages(message_fixture(spark, base), root, folders=FOLDERS)
    arriving = stream_messages(spark, root, max_files_per_trigger=max(1, -(-n // 4)))
    sink, _ = W.append_batches(ingest(arriving), "stream-ingest")
    return spark.read.parquet(sink).drop("batch")


@register("stream_message_funnel", f"""
WITH r AS ({INGEST_SQL}),
f AS (SELECT CASE WHEN masked_status LIKE 'error%' THEN 'parse_error' WHEN masked_status = 'ok' THEN 'passed' ELSE masked_status END AS o,
             email_text_masked AS t FROM r)
SELECT 'found' AS outcome, count(*) AS n FROM f
UNION ALL SELECT o, count(*) FROM f WHERE o <> 'passed' GROUP BY o
UNION ALL SELECT 'collected', count(DISTINCT t) FROM f WHERE o = 'passed'
UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT t) FROM f WHERE o = 'passed'""")
def stream_message_funnel(spark, base):
    """The funnel of arriving message files, with those that cannot be parsed."""
    from pyspark.sql import functions as F
    root = scratch_path(spark, "stream-messages")
    n = write_messages(message_fixture(spark, base), root, folders=FOLDERS)
    arriving = clean_messages(stream_messages(spark, root, max_files_per_trigger=max(1, -(-n // 4)))).select(
        F.col("body_m").alias("body"), "email_text", fingerprint("email_text").alias("fp"), (F.col("parse_status") == "ok").alias("parsed"))
    sink = W.running_funnel(arriving, "message-funnel", "body", "email_text", "fp", parsed_col="parsed")
    return W.funnel_so_far(spark, sink).select("outcome", F.col("n").cast("bigint").alias("n"))
