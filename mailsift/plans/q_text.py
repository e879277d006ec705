"""Registered queries: text and HTML scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import patterns as P
from ..operators.compute import with_computed, with_html_text
from ..sources.tables import documents, pages
from . import sqltext as S
from .fixtures import injected_text, injected_text_sql, qp_html, qp_html_sql
from .registry import register


def _docs_injected(spark, base):
    d = documents(spark, base, "doc_id", "text")
    return d.select("doc_id", injected_text().alias("text"))


_INJ = f"(SELECT doc_id, {injected_text_sql()} AS text FROM documents)"


def _text_query(name, spark_fn, sql_fn, out="text_out"):
    @register(name, f"SELECT doc_id, {sql_fn('text')} AS {out} FROM {_INJ} t")
    def q(spark, base):
        return _docs_injected(spark, base).select("doc_id", spark_fn(F.col("text")).alias(out))
    q.__name__ = name
    return q


_text_query("clean_masked", T.clean_masked, S.clean_masked, "email_text")
_text_query("clean_compact", T.clean_compact, S.clean_compact, "email_text")
_text_query("mask_emails", T.mask_emails, S.mask_emails)
_text_query("collapse_blanks", T.collapse_blanks, S.collapse_blanks)
_text_query("collapse_blank_lines", T.collapse_blank_lines, S.collapse_blank_lines)
_text_query("collapse_whitespace", T.collapse_whitespace, S.collapse_whitespace)
_text_query("strip_controls", T.strip_controls, S.strip_controls)
_text_query("quote_normalise", T.normalise_quotes, lambda x: x)
# quotes set the way a word processor does, so that there is something to undo
_CURLY_SQL = "translate('“' || text || '”', '''\"', '’“')"


@register("quote_typographic", f"""
SELECT doc_id, replace(replace(replace(replace({_CURLY_SQL}, '“', '"'), '”', '"'), '‘', ''''), '’', '''') AS text_out FROM documents""")
def quote_typographic(spark, base):
    """T7 with ``typographic=True``: curly quotes become plain ones."""
    curly = F.translate(F.concat(F.lit("“"), F.col("text"), F.lit("”")), "'\"", "’“")
    d = documents(spark, base, "doc_id", "text")
    return d.select("doc_id", T.normalise_quotes(curly, typographic=True).alias("text_out"))


_text_query("truncate_strip", lambda c: T.strip(T.truncate(c, P.MASKED_SUBJECT_MAX_CHARS)),
            lambda x: S.strip(S.truncate(x, P.MASKED_SUBJECT_MAX_CHARS)))
_text_query("mask_long_words", lambda c: T.mask_long_words(c, 20), lambda x: S.mask_long_words(x, 20))
_text_query("clean_masked_subject", lambda c: T.clean_masked(c, P.MASKED_SUBJECT_MAX_CHARS),
            lambda x: S.clean_masked(x, P.MASKED_SUBJECT_MAX_CHARS), "subject")


@register("mask_urls", f"""
SELECT page_id, {S.mask_urls("('see ' || url || ', then ' || url || '/next ' || html)")} AS text_out FROM pages""")
def mask_urls(spark, base):
    """T1 over page URLs embedded in text."""
    p = pages(spark, base, "page_id", "url", "html")
    txt = F.concat(F.lit("see "), F.col("url"), F.lit(", then "), F.col("url"), F.lit("/next "), F.col("html"))
    return p.select("page_id", T.mask_urls(txt).alias("text_out"))


@register("fingerprint", f"SELECT doc_id, {S.fingerprint('text')} AS fp FROM documents")
def fingerprint_q(spark, base):
    """T12 over whole documents."""
    return documents(spark, base, "doc_id", "text").select("doc_id", T.fingerprint("text").alias("fp"))


@register("preview", f"""
SELECT doc_id, substring(text, 1, {P.PREVIEW_CHARS}) || '...' AS preview FROM documents""")
def preview_q(spark, base):
    """T14."""
    return documents(spark, base, "doc_id", "text").select("doc_id", T.preview("text").alias("preview"))


@register("compose_subject", f"""
SELECT doc_id, {S.compose("subject", "text")} AS email_text FROM
  (SELECT doc_id, text, CASE WHEN lang = 'en' THEN '' ELSE substring(split_part(text, chr(10), 1), 1, 60) END AS subject
   FROM documents) t""")
def compose_subject(spark, base):
    """M8: subject + blank line + body when a subject exists (English rows carry none)."""
    d = documents(spark, base, "doc_id", "text", "lang")
    subj = F.when(F.col("lang") == "en", F.lit("")).otherwise(
        F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 60))
    return d.select("doc_id", T.compose(subj, F.col("text")).alias("email_text"))


def _html_query(name, profile, src=None, src_sql="html"):
    @register(name, f"SELECT page_id, {S.html_to_text(src_sql, profile)} AS text_out FROM pages")
    def q(spark, base):
        p = pages(spark, base, "page_id", "html")
        p = p.select("page_id", (src() if src else F.col("html")).alias("html"))
        return with_html_text(p, "html", "text_out", profile).select("page_id", "text_out")
    q.__name__ = name
    return q


_html_query("html_text_masked", H.MASKED)
_html_query("html_text_compact", H.COMPACT)
_html_query("qp_repair", H.MASKED, src=qp_html, src_sql=qp_html_sql())


@register("html_strip_fallback", f"SELECT page_id, {S.html_fallback('html')} AS text_out FROM pages")
def html_strip_fallback(spark, base):
    """H4: the fallback tag strip."""
    p = pages(spark, base, "page_id", "html")
    return p.select("page_id", H.strip_tags_fallback("html").alias("text_out"))


@register("html_clean_masked", f"""
SELECT page_id, {S.clean_masked(S.html_to_text('html', 'masked'))} AS email_text FROM pages""")
def html_clean_masked(spark, base):
    """H1 then T11 (masked), the path of an HTML-only message body."""
    p = pages(spark, base, "page_id", "html")
    body = with_computed(with_html_text(p, "html", "body", H.MASKED), email_text=T.clean_masked("body"))
    return body.select("page_id", "email_text")


@register("contains_keyword", """
SELECT doc_id, contains(lower(text), 'the') AS has_kw FROM documents""")
def contains_keyword(spark, base):
    """Case-insensitive keyword test."""
    return documents(spark, base, "doc_id", "text").select("doc_id", T.contains_ci("text", "the").alias("has_kw"))
