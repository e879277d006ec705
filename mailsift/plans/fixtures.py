"""Derived inputs for queries whose operators the raw tables would not exercise.

The corpus tables contain no URLs in ``documents``, no control characters, no blank-line
runs and no long encoded words, so some queries append such material to every row — the
same for every row, by expression, in both the Spark builder and the oracle SQL. Each piece
is ``("col", name)``, ``("lit", text)`` or ``("md5", name)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sqltext as S

# FIXED VALUES: the material appended to every document for the cleaning queries.
INJECTED_TAIL = [
    ("lit", " Visit https://portal.example.com/login?id="), ("col", "doc_id"),
    ("lit", ", or http://x.example.org/a"), ("lit", "\n\n \n\t\n"),
    ("lit", "Mail admin."), ("col", "doc_id"), ("lit", "@corp-example.co.uk now.  \t "),
    ("lit", "\x07\x01\x1b\x7f\x85\x0b\x0c"), ("lit", "\xa0end "),
    ("md5", "text"), ("md5", "doc_id"),
    ("lit", " “quoted” ‘x’ \r\n\r\n\r\n"), ("lit", "tail　 \n"),
]


def spark_concat(prefix_col: str, pieces) -> Column:
    parts = [F.col(prefix_col)]
    for kind, v in pieces:
        if kind == "col":
            parts.append(F.col(v).cast("string"))
        elif kind == "lit":
            parts.append(F.lit(v))
        elif kind == "md5":
            parts.append(F.md5(F.col(v).cast("string")))
    return F.concat(*parts)


def sql_concat(prefix_col: str, pieces) -> str:
    parts = [prefix_col]
    for kind, v in pieces:
        if kind == "col":
            parts.append(f"CAST({v} AS VARCHAR)")
        elif kind == "lit":
            parts.append(S.lit(v))
        elif kind == "md5":
            parts.append(f"md5(CAST({v} AS VARCHAR))")
    return "(" + " || ".join(parts) + ")"


def injected_text() -> Column:
    return spark_concat("text", INJECTED_TAIL)


def injected_text_sql() -> str:
    return sql_concat("text", INJECTED_TAIL)


# FIXED VALUES: quoted-printable residue appended to every page for the QP-repair query.
QP_TAIL = [("lit", '<p><a href=3D"x">go=20now</a> a=\r\nb=3Dc</p>')]


def qp_html() -> Column:
    return spark_concat("html", QP_TAIL)


def qp_html_sql() -> str:
    return sql_concat("html", QP_TAIL)
