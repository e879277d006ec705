"""Golden cases for message parsing and body choice (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from mailsift.operators.mime import choose_body, parse_messages

PL = "This is a long enough plain body."
H1 = "<p>Hello <b>world</b>, html part here</p>"
H2 = "<div>Second html part is also here</div>"


def multipart(parts, subject="s"):
    b = "BOUND"
    out = [f"Subject: {subject}", "MIME-Version: 1.0", f'Content-Type: multipart/mixed; boundary="{b}"', ""]
    for ctype, body, disp in parts:
        out.append(f"--{b}")
        out.append(f"Content-Type: {ctype}; charset=utf-8")
        if disp:
            out.append(f"Content-Disposition: {disp}")
        out.append("")
        out.append(body)
    out.append(f"--{b}--")
    return "\r\n".join(out).encode()


def single(ctype, body, cte=None, charset="utf-8"):
    head = [f"Subject: s", "MIME-Version: 1.0", f"Content-Type: {ctype}; charset={charset}"]
    if cte:
        head.append(f"Content-Transfer-Encoding: {cte}")
    return ("\r\n".join(head) + "\r\n\r\n" + body).encode("latin-1")


CASES = [
    ("plain_html", multipart([("text/plain", PL, None), ("text/html", H1, None)]), PL, PL),
    ("html_plain", multipart([("text/html", H1, None), ("text/plain", PL, None)]),
     "Hello world, html part here\n" + PL, "Hello world, html part here\n\n" + PL),
    ("short_plain_html", multipart([("text/plain", "short", None), ("text/html", H1, None)]),
     "short", "Hello world, html part here"),
    ("two_html", multipart([("text/html", H1, None), ("text/html", H2, None)]),
     "Hello world, html part here", "Hello world, html part here\n\nSecond html part is also here"),
    ("attachment_html", multipart([("text/plain", PL, "attachment; filename=a.txt"), ("text/html", H1, None)]),
     "Hello world, html part here", "Hello world, html part here"),
    ("upper_attachment", multipart([("text/plain", "upper case attachment text here", "ATTACHMENT; filename=a"),
                                    ("text/html", H1, None)]),
     "upper case attachment text here", "upper case attachment text here"),
    ("single_b64", single("text/plain", "VmVyaWZpcXVlIHN1IGN1ZW50YSBhaG9yYSBtaXNtbw==", "base64"),
     "Verifique su cuenta ahora mismo", "Verifique su cuenta ahora mismo"),
    ("single_qp", single("text/plain", "Contrase=F1a caduca=\r\n hoy", "quoted-printable", "iso-8859-1"),
     "Contraseña caduca hoy", "Contraseña caduca hoy"),
    ("unknown_charset", single("text/plain", "plain ascii text", None, "x-none"), "plain ascii text", "plain ascii text"),
    ("pdf", single("application/pdf", "%PDF-1.4 raw"), "%PDF-1.4 raw", "%PDF-1.4 raw"),
    ("bad_part", multipart([("text/plain; charset=idna; x", PL, None), ("text/plain; charset=undefined; x", PL, None),
                            ("text/plain", "the good part of this message", None)]),
     "the good part of this message", "the good part of this message"),
    ("bad_single", single("text/plain", "whatever is in here", None, "undefined"), "", ""),
    ("qp_residue_html", single("text/html", '<a href=3D"x">go=20now</a> a=\r\nb', "7bit"), "go=20now a= b", "go now ab"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(name, bytearray(raw)) for name, raw, _, _ in CASES]
    raw = spark.createDataFrame(rows, "path string, content binary")
    out = parse_messages(raw).select("path", "parse_status", "subject",
                                     choose_body("parts", "multipart", "compact").alias("a"),
                                     choose_body("parts", "multipart", "masked").alias("b"))
    return {r["path"]: r for r in out.collect()}


@pytest.mark.parametrize("name,raw,a,b", CASES, ids=[c[0] for c in CASES])
def test_body_choice(parsed, name, raw, a, b):
    r = parsed[name]
    assert r["parse_status"] == "ok"
    assert r["a"] == a
    assert r["b"] == b


def test_encoded_subject(spark):
    raw = b"Subject: =?utf-8?q?Verificaci=C3=B3n_urgente?= hola\r\n\r\nbody text\r\n"
    df = spark.createDataFrame([("x", bytearray(raw))], "path string, content binary")
    r = parse_messages(df).collect()[0]
    assert r["subject"] == "Verificación urgente hola"
    assert r["from_addr"] == ""


def test_broken_message_is_rejected_not_fatal(spark):
    df = spark.createDataFrame([("bad", None), ("ok", bytearray(b"Subject: a\r\n\r\nhello"))],
                               "path string, content binary")
    rows = {r["path"]: r["parse_status"] for r in parse_messages(df).collect()}
    assert rows["ok"] == "ok" and rows["bad"].startswith("error")


def test_ingest_matches_tables(spark):
    """The full file job returns every composed message with the cleaned text."""
    from __spark_entry__ import queries
    from mailsift.functions.text import clean_masked
    from mailsift.sources.tables import documents
    out = queries()["mime_ingest"](spark, "/root/testdata/sf0.001")
    docs = documents(spark, "/root/testdata/sf0.001", "doc_id", "lang", "text")
    odd = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert out.count() == docs.count() + 3 * odd          # each item as no text, behind bad parts, and broken
    assert out.where(F.col("masked_status").startswith("error")).count() == odd
    # Spanish messages: plain part first and long enough, so the masked body is the cleaned text
    es = docs.where(F.col("lang") == "es").select("doc_id", clean_masked("text").alias("exp"))
    j = out.join(es, "doc_id").where(F.col("masked_status") == "ok")
    bad = j.where(~F.col("email_text_masked").endswith(F.col("exp"))).count()
    assert j.count() > 0 and bad == 0
