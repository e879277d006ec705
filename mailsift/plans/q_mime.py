"""Registered queries: message composition, header fields, part choice and the full MIME
ingest (S1 M1–M8 F1 F3 F4 F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clean_compact, clean_masked, compose
from ..operators.compute import with_computed
from ..operators.mime import choose_body, header_field, parse_messages, parts_by_message
from ..session import scratch_path
from ..sources.eml import FOLDERS, compose_message, pack_messages, packed_messages, scan_messages, write_messages
from ..sources.tables import documents, pages, read_table
from . import sqltext as S
from .registry import register

CRLF = "\r\n"


def _subject(text_col="text"):
    return F.substring(F.split_part(F.col(text_col), F.lit("\n"), F.lit(1)), 1, 60)


_SUBJ_SQL = "substring(split_part(text, chr(10), 1), 1, 60)"


def _header_block():
    return F.concat(F.lit("From: "), F.col("source"), F.lit("@example.org" + CRLF + "To: inbox@example.com" + CRLF
                                                            + "Subject: "), _subject(),
                    F.lit(CRLF + "Return-Path: <"), F.col("source"), F.lit("@example.org>" + CRLF + CRLF), F.col("text"))


_HEADER_SQL = (f"('From: ' || source || '@example.org' || {S.lit(CRLF)} || 'To: inbox@example.com' || {S.lit(CRLF)} "
               f"|| 'Subject: ' || {_SUBJ_SQL} || {S.lit(CRLF)} || 'Return-Path: <' || source || '@example.org>' "
               f"|| {S.lit(CRLF + CRLF)} || text)")


def _hf_sql(name: str) -> str:
    return (f"regexp_extract(split_part(raw, {S.lit(CRLF + CRLF)}, 1), "
            f"{S.lit(f'(?im)^{name}:[ \t]*([^' + chr(13) + chr(10) + ']*)')}, 1)")


@register("header_fields", f"""
SELECT doc_id, {_hf_sql('Subject')} AS subject, {_hf_sql('From')} AS from_addr, {_hf_sql('To')} AS to_addr,
       {_hf_sql('Date')} AS date, {_hf_sql('Return-Path')} AS return_path
FROM (SELECT doc_id, {_HEADER_SQL} AS raw FROM documents) m""")
def header_fields(spark, base):
    """M2 on plain headers: subject, from, to, date, return path; a missing header is ''."""
    d = documents(spark, base, "doc_id", "source", "text").select("doc_id", _header_block().alias("raw"))
    return d.select("doc_id", *[header_field("raw", h).alias(a) for h, a in
                                (("Subject", "subject"), ("From", "from_addr"), ("To", "to_addr"),
                                 ("Date", "date"), ("Return-Path", "return_path"))])


# part table: per document, parts in an order that depends on its language
#   en: html, plain · es: plain, html · fr: short plain, plain, html · de: attachment, html, plain
# and an upper-case ATTACHMENT disposition (which is *not* skipped) for source src1.
def part_table(spark, base):
    d = documents(spark, base, "doc_id", "lang", "source", "text")
    p = pages(spark, base, "page_id", "html")
    plain_idx = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).otherwise(0)
    plain_disp = F.when(F.col("source") == "src1", F.lit("ATTACHMENT; filename=b.txt")).otherwise(F.lit(""))
    plain = d.select(F.col("doc_id").alias("msg_id"), plain_idx.alias("idx"), F.lit("text/plain").alias("content_type"),
                     plain_disp.alias("disposition"), F.lit("utf-8").alias("charset"), F.col("text"))
    short = (d.where(F.col("lang") == "fr")
             .select(F.col("doc_id").alias("msg_id"), F.lit(-1).alias("idx"), F.lit("text/plain").alias("content_type"),
                     F.lit("").alias("disposition"), F.lit("utf-8").alias("charset"), F.substring("text", 1, 15).alias("text")))
    html = (d.join(p, d.doc_id == p.page_id)
            .select(F.col("doc_id").alias("msg_id"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("idx"),
                    F.lit("text/html").alias("content_type"), F.lit("").alias("disposition"),
                    F.lit("utf-8").alias("charset"), F.col("html").alias("text")))
    att = (d.where(F.col("lang") == "de")
           .select(F.col("doc_id").alias("msg_id"), F.lit(0).alias("idx"), F.lit("text/plain").alias("content_type"),
                   F.lit("attachment; filename=notes.txt").alias("disposition"), F.lit("utf-8").alias("charset"),
                   F.col("text")))
    return plain.unionByName(short).unionByName(html).unionByName(att)


_PARTS_SQL = """(
SELECT doc_id AS msg_id, CASE WHEN lang = 'en' THEN 1 WHEN lang = 'de' THEN 2 ELSE 0 END AS idx,
       'text/plain' AS content_type, CASE WHEN source = 'src1' THEN 'ATTACHMENT; filename=b.txt' ELSE '' END AS disposition,
       text FROM documents
UNION ALL
SELECT doc_id, -1, 'text/plain', '', substring(text, 1, 15) FROM documents WHERE lang = 'fr'
UNION ALL
SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 0 ELSE 1 END, 'text/html', '', p.html
FROM documents d JOIN pages p ON d.doc_id = p.page_id
UNION ALL
SELECT doc_id, 0, 'text/plain', 'attachment; filename=notes.txt', text FROM documents WHERE lang = 'de')"""


def _choice_sql(profile: str, parts: str | None = None) -> str:
    conv = f"CASE WHEN content_type = 'text/html' THEN {S.html_to_text('coalesce(text, chr(0))'.replace('chr(0)', chr(39) * 2), profile)} ELSE coalesce(text, '') END"
    na = "NOT contains(coalesce(disposition, ''), 'attachment') AND coalesce(text, '') <> ''"
    if profile == "compact":
        flags = f"""c AS (SELECT *, ({na} AND content_type IN ('text/plain', 'text/html')) AS cand FROM cv),
k AS (SELECT *, coalesce(count(*) FILTER (WHERE cand) OVER (PARTITION BY msg_id ORDER BY idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM c),
t AS (SELECT *, cand AND (content_type = 'text/plain' OR prior = 0) AS taken FROM k)"""
    else:
        flags = f"""c AS (SELECT *, ({na} AND content_type = 'text/plain' AND length({S.strip('conv')}) > {P.SUBSTANTIAL_PART})
                  AS plain_ok FROM cv),
k AS (SELECT *, coalesce(count(*) FILTER (WHERE plain_ok) OVER (PARTITION BY msg_id ORDER BY idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM c),
t AS (SELECT *, plain_ok OR ({na} AND content_type = 'text/html' AND prior = 0
                                AND length({S.strip('conv')}) > {P.SUBSTANTIAL_PART}) AS taken FROM k)"""
    return f"""
WITH cv AS (SELECT msg_id, idx, content_type, disposition, text, {conv} AS conv FROM {parts or _PARTS_SQL} p),
{flags}
SELECT msg_id, {S.strip("coalesce(string_agg(conv, chr(10) ORDER BY idx) FILTER (WHERE taken), '')")} AS body
FROM t GROUP BY msg_id"""


@register("part_choice_masked", _choice_sql("masked"))
def part_choice_masked(spark, base):
    """M5 M6 F3, masked profile, from a part table (one keyed shuffle to rebuild messages)."""
    msgs = parts_by_message(part_table(spark, base))
    return msgs.select("msg_id", choose_body("parts", profile="masked").alias("body"))


@register("part_choice_compact", _choice_sql("compact"))
def part_choice_compact(spark, base):
    """M5 M6, compact profile."""
    msgs = parts_by_message(part_table(spark, base))
    return msgs.select("msg_id", choose_body("parts", profile="compact").alias("body"))


#: Layouts of the messages made of the benchmark's items, and the numbers from which these are named.
ODD_LAYOUTS = {"pdf_b64": 10**12, "bad_part": 2 * 10**12, "broken": 3 * 10**12}


def message_fixture(spark, base):
    """Raw messages composed from documents (+ their page as the HTML part)."""
    d = documents(spark, base, "doc_id", "lang", "source", "text")
    p = pages(spark, base, "page_id", "html")
    m = d.join(p, d.doc_id == p.page_id, "left")
    layout = (F.when(F.col("lang") == "de", F.lit("single_b64")).when(F.col("lang") == "en", F.lit("html_plain"))
              .when(F.col("lang") == "fr", F.lit("attach_html")).otherwise(F.lit("plain_html")))
    sent = m.select("doc_id", "source", "text", "html", layout.alias("layout"))
    # every benchmark item as one part that is no text, behind two undecodable parts, and in a broken message
    odd = read_table(spark, base, "benchmark", "item_id", "text").withColumn("kind", F.explode(F.array(*map(F.lit, ODD_LAYOUTS))))
    first = F.element_at(F.create_map(*[F.lit(x) for k, v in ODD_LAYOUTS.items() for x in (k, v)]), F.col("kind"))
    odd = odd.select((first + F.col("item_id")).alias("doc_id"), F.lit("bench").alias("source"), "text",
                     F.lit(None).cast("string").alias("html"), F.col("kind").alias("layout"))
    every = sent.unionByName(odd)
    msg = compose_message(F.col("doc_id"), F.col("source"), _subject(), F.col("text"), F.col("html"), F.col("layout"))
    return every.select("doc_id", msg.alias("message"))


def clean_messages(messages):
    """The masked profile of scanned or arriving messages: parsed, ``body_m`` and the composed ``email_text``."""
    bodies = with_computed(parse_messages(messages), body_masked=choose_body("parts", "multipart", "masked"))
    staged = with_computed(bodies, subject_m=clean_masked("subject", P.MASKED_SUBJECT_MAX_CHARS),
                           body_m=clean_masked("body_masked", P.MASKED_BODY_MAX_CHARS))
    return staged.withColumn("email_text", compose("subject_m", "body_m"))


def ingest(messages):
    """M1 → M3/M4 → M5/M7 → T11 → M8 → F1/F2 for both profiles, of scanned or arriving messages."""
    parsed = parse_messages(messages)
    bodies = with_computed(parsed, body_masked=choose_body("parts", "multipart", "masked"),
                           body_compact=choose_body("parts", "multipart", "compact"))
    subj_m = clean_masked("subject", P.MASKED_SUBJECT_MAX_CHARS)
    body_m = clean_masked("body_masked", P.MASKED_BODY_MAX_CHARS)
    # stored once: the statuses read the cleaned texts again
    staged = with_computed(bodies, subject_m=subj_m, body_m=body_m, text_c=clean_compact(compose("subject", "body_compact")))
    masked_text, compact_text = compose("subject_m", "body_m"), F.col("text_c")
    status = (F.when(F.col("parse_status") != "ok", F.col("parse_status"))
              .when(F.length("body_m") < P.MASKED_MIN_BODY, F.lit("short_body"))
              .when(F.length(masked_text) < P.MIN_TEXT_LENGTH, F.lit("short_text"))
              .otherwise(F.lit("ok")))
    compact_status = (F.when(F.col("parse_status") != "ok", F.col("parse_status"))
                      .when(F.length("body_compact") < P.COMPACT_MIN_BODY, F.lit("short_body"))
                      .when(F.length(compact_text) < P.MIN_TEXT_LENGTH, F.lit("short_text"))
                      .otherwise(F.lit("ok")))
    return staged.select(F.regexp_extract("message_id", r"<(\d+)@", 1).try_cast("bigint").alias("doc_id"),
                         "subject", "from_addr", "to_addr", "date", "return_path",
                         status.alias("masked_status"), masked_text.alias("email_text_masked"),
                         compact_status.alias("compact_status"), compact_text.alias("email_text_compact"))


# what the parser must find: the parts of message_fixture's layouts, in order
_MESSAGE_PARTS_SQL = """(
SELECT doc_id AS msg_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 0 END AS idx, 'text/plain' AS content_type,
       '' AS disposition, text FROM documents WHERE lang <> 'de'
UNION ALL
SELECT d.doc_id, CASE d.lang WHEN 'en' THEN 0 ELSE 1 END, 'text/html', '', p.html
FROM documents d JOIN pages p ON d.doc_id = p.page_id WHERE d.lang <> 'de'
UNION ALL
SELECT doc_id, 0, 'text/plain', 'attachment; filename=notes.txt', text FROM documents WHERE lang = 'fr')"""


def _ingest_sql() -> str:
    def status(body: str, least: int, text: str) -> str:
        return (f"CASE WHEN length({body}) < {least} THEN 'short_body' "
                f"WHEN length({text}) < {P.MIN_TEXT_LENGTH} THEN 'short_text' ELSE 'ok' END")
    return f"""
WITH m AS ({_choice_sql("masked", _MESSAGE_PARTS_SQL)}),
k AS ({_choice_sql("compact", _MESSAGE_PARTS_SQL)}),
b AS (SELECT d.doc_id, d.source, {_SUBJ_SQL.replace("text", "d.text")} AS subject,
             CASE WHEN d.lang = 'de' THEN {S.strip("d.text")} ELSE coalesce(m.body, '') END AS body_masked,
             CASE WHEN d.lang = 'de' THEN {S.strip("d.text")} ELSE coalesce(k.body, '') END AS body_compact
      FROM documents d LEFT JOIN m ON m.msg_id = d.doc_id LEFT JOIN k ON k.msg_id = d.doc_id),
o AS (SELECT * FROM b UNION ALL
      SELECT first + item_id, 'bench', {_SUBJ_SQL}, {S.strip("text")}, {S.strip("text")} FROM benchmark,
             (VALUES ({ODD_LAYOUTS["pdf_b64"]}), ({ODD_LAYOUTS["bad_part"]})) x(first)),
c AS (SELECT *, {S.clean_masked("subject", P.MASKED_SUBJECT_MAX_CHARS)} AS subject_m,
             {S.clean_masked("body_masked", P.MASKED_BODY_MAX_CHARS)} AS body_m FROM o),
t AS (SELECT *, {S.compose("subject_m", "body_m")} AS masked_text,
             {S.clean_compact("(" + S.compose("subject", "body_compact") + ")")} AS compact_text FROM c)
SELECT doc_id, subject, source || '@example.org' AS from_addr, 'inbox@example.com' AS to_addr,
       'Mon, 01 Jan 2024 00:00:00 +0000' AS date, '<' || source || '@example.org>' AS return_path,
       {status("body_m", P.MASKED_MIN_BODY, "masked_text")} AS masked_status, masked_text AS email_text_masked,
       {status("body_compact", P.COMPACT_MIN_BODY, "compact_text")} AS compact_status,
       compact_text AS email_text_compact
FROM t
UNION ALL
SELECT NULL, '', '', '', '', '', 'error: IndexError', '', 'error: IndexError', '' FROM benchmark"""


INGEST_SQL = _ingest_sql()


@register("mime_ingest", INGEST_SQL)
def mime_ingest(spark, base):
    """Compose messages from the tables, write one file each, scan the
    tree, parse, choose the body and clean it. The SQL says from the tables what must come out."""
    root = scratch_path(spark, "messages")
    write_messages(message_fixture(spark, base), root, folders=FOLDERS)
    return ingest(scan_messages(spark, root))


@register("packed_ingest", INGEST_SQL)
def packed_ingest(spark, base):
    """S1 from containers: message files in sub-folders, listed in tasks and packed, then ingested."""
    root, out = scratch_path(spark, "folders"), scratch_path(spark, "containers")
    write_messages(message_fixture(spark, base), root, folders=16)
    pack_messages(spark, root, out, target_bytes=1 << 20)
    return ingest(packed_messages(spark, out))
