"""MIME ingest.

M1 is the only Python step of the engine: ``mapInArrow`` runs the standard-library MIME
parser over Arrow batches of raw messages and emits one row per message with its header
fields, a parse status (a broken message never fails the job) and the ordered array of
leaf parts ``(idx, content_type, disposition, charset, text)``. Everything after that —
attachment filter, part choice per profile, HTML conversion, cleaning, composition — is a
native expression over that array (``filter``/``transform``/``exists``), so no shuffle is
needed to reassemble a message.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.html import COMPACT, MASKED, html_to_text
from ..functions.text import strip

PART_TYPE = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("content_type", T.StringType()),
    T.StructField("disposition", T.StringType()), T.StructField("charset", T.StringType()),
    T.StructField("text", T.StringType())])

PARSED_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("parse_status", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("from_addr", T.StringType()),
    T.StructField("to_addr", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("return_path", T.StringType()), T.StructField("multipart", T.BooleanType()),
    T.StructField("parts", T.ArrayType(PART_TYPE))])


BODY_TYPES = ("text/plain", "text/html")


def _header(msg, name: str) -> str:
    """M3: the modern e-mail policy decodes encoded words when a header is read."""
    return str(msg[name] or "")


def _charset(part) -> str:
    """M4: the declared character set; UTF-8 if none is declared or Python has no such text codec."""
    name = part.get_content_charset("utf-8")
    try:
        "".encode(name)
    except LookupError:
        return "utf-8"
    return name


def _leaf(idx: int, part, whole: bool = False) -> dict:
    """One part of the array, or the ``whole`` message. The transfer encoding is undone only for parts that can become body
    text, so attachments are neither decoded nor shipped. A part that cannot be decoded has no text;
    the message keeps its others."""
    text, kind, disposition = None, part.get_content_type(), _header(part, "Content-Disposition")
    if whole or kind in BODY_TYPES and "attachment" not in disposition:
        try:
            raw = part.get_payload(decode=True)
            text = str(raw, _charset(part), "replace") if raw else None
        except Exception:  # noqa: BLE001 — codecs that refuse to decode (idna, undefined), broken payloads
            text = None
    return {"idx": idx, "content_type": kind, "disposition": disposition,
            "charset": part.get_content_charset(), "text": text}


@lru_cache(maxsize=1)
def _policy():
    """The modern policy, which parses a header each time it is read; here a header line that was seen before, such as
    the content type of most parts, is not parsed again."""
    from email import policy
    from email.headerregistry import HeaderRegistry
    return policy.default.clone(header_factory=lru_cache(maxsize=4096)(HeaderRegistry()))


def parse_message(raw: bytes) -> dict:
    """One message → header fields + ordered leaf parts (small per-row helper)."""
    from email.parser import BytesParser
    msg = BytesParser(policy=_policy()).parsebytes(raw)
    if msg.is_multipart():
        leaves = [(i, p) for i, p in enumerate(msg.walk()) if not p.is_multipart()]
        parts = [_leaf(i, p) for i, p in leaves]
    else:
        parts = [_leaf(0, msg, whole=True)]
    return {"message_id": _header(msg, "Message-ID"), "subject": _header(msg, "Subject"),
            "from_addr": _header(msg, "From"), "to_addr": _header(msg, "To"), "date": _header(msg, "Date"),
            "return_path": _header(msg, "Return-Path"), "multipart": msg.is_multipart(), "parts": parts}


def _parse_batches(schema):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 500):        # a few hundred parsed messages in memory at once
                part, rows = batch.slice(at, 500), []
                for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                    try:
                        r = parse_message(content)
                        r["parse_status"] = "ok"
                    except Exception as e:  # noqa: BLE001 — F4: reject the row, keep the job
                        r = {"message_id": "", "subject": "", "from_addr": "", "to_addr": "", "date": "", "return_path": "",
                             "multipart": False, "parts": [], "parse_status": f"error: {type(e).__name__}"}
                    r["path"] = path
                    rows.append(r)
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def parse_messages(raw: DataFrame) -> DataFrame:
    """M1: binaryFile rows ``(path, content)`` → :data:`PARSED_SCHEMA` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..session import ship_package
    ship_package(raw.sparkSession)
    return raw.select("path", "content").mapInArrow(_parse_batches(to_arrow_schema(PARSED_SCHEMA)), PARSED_SCHEMA)


# ---------------------------------------------------------------------------------------
# body choice over the part array (native)
# ---------------------------------------------------------------------------------------

def _not_attachment(p: Column) -> Column:
    """M6: the test is a case-sensitive substring test on Content-Disposition."""
    return ~F.coalesce(p["disposition"], F.lit("")).contains("attachment")


def _has_payload(p: Column) -> Column:
    return F.coalesce(p["text"], F.lit("")) != ""


def choose_body(parts: Column | str, multipart: Column | str | None = None, profile: str = MASKED) -> Column:
    """M5 (+ M7 when ``multipart`` is false): the message body chosen from its parts.

    ``compact``: every non-empty plain part; an HTML part only while nothing was taken.
    ``masked``: plain parts with > 20 non-blank characters; an HTML part (converted) with
    > 20 characters while no plain part was taken yet; several HTML parts are all kept.
    Result: parts joined with ``\\n`` and stripped.
    """
    arr = F.col(parts) if isinstance(parts, str) else parts
    conv = F.transform(arr, lambda p: F.struct(
        p["idx"].alias("idx"), p["content_type"].alias("content_type"), p["disposition"].alias("disposition"),
        p["text"].alias("text"),
        F.when(p["content_type"] == "text/html", html_to_text(F.coalesce(p["text"], F.lit("")), profile))
        .otherwise(F.coalesce(p["text"], F.lit(""))).alias("conv")))
    if profile == COMPACT:
        cands = F.filter(conv, lambda p: _not_attachment(p) & _has_payload(p)
                         & p["content_type"].isin("text/plain", "text/html"))
        taken = F.filter(cands, lambda p, i: (p["content_type"] == "text/plain") | (i == 0))
    elif profile == MASKED:
        def plain_ok(p):
            # a plain part is not converted, so the raw array answers this too
            return (_not_attachment(p) & _has_payload(p) & (p["content_type"] == "text/plain")
                    & (F.length(strip(F.coalesce(p["text"], F.lit("")))) > P.SUBSTANTIAL_PART))

        def html_ok(p, i):
            return (_not_attachment(p) & _has_payload(p) & (p["content_type"] == "text/html")
                    & ~F.exists(F.slice(arr, 1, i), plain_ok)
                    & (F.length(strip(p["conv"])) > P.SUBSTANTIAL_PART))

        taken = F.filter(conv, lambda p, i: plain_ok(p) | html_ok(p, i))
    else:
        raise ValueError(f"unknown profile {profile!r}")
    body = strip(F.array_join(F.transform(taken, lambda p: p["conv"]), "\n"))
    if multipart is None:
        return body
    mp = F.col(multipart) if isinstance(multipart, str) else multipart
    single = F.get(conv, F.lit(0))        # a message that could not be parsed has no part
    single_body = strip(F.when(_has_payload(single), single["conv"]).otherwise(F.lit("")))
    return F.when(mp, body).otherwise(F.coalesce(single_body, F.lit("")))


def parts_by_message(part_rows: DataFrame, msg_col: str = "msg_id") -> DataFrame:
    """Reassemble a part table into one ordered array per message (one keyed shuffle;
    a message has a handful of parts)."""
    packed = F.struct(F.col("idx").cast("int").alias("idx"), F.col("content_type"), F.col("disposition"),
                      F.col("charset"), F.col("text"))
    return part_rows.groupBy(msg_col).agg(F.sort_array(F.collect_list(packed)).alias("parts"))


def header_field(raw_text: Column | str, name: str) -> Column:
    """M2 for plain (unfolded, unencoded) headers: the value of the first ``name:`` line."""
    t = F.col(raw_text) if isinstance(raw_text, str) else raw_text
    head = F.split_part(t, F.lit("\r\n\r\n"), F.lit(1))
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
