"""Registered queries: synthetic negatives, the balanced corpus job and the boilerplate
audit (G1 G2 G3 T13 U1 S2 S4 A1 A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import synth as G
from ..operators.dedup import dedup_keep_first
from ..operators.sample import cap_rows, positive_cap, seeded_shuffle
from ..session import materialize, scratch_path
from ..sources.labelled import read_labelled_csv, write_labelled_csv
from ..sources.tables import labelled_documents
from . import sqltext as S
from .corpus import clean_labelled
from .q_corpus import CLEAN_LABELLED_SQL
from .registry import register


def _h(id_expr: str, field: str) -> str:
    return (f"CAST(('0x' || substr(md5('{G.SYNTH_STAGE}:42:' || CAST({id_expr} AS VARCHAR) || ':{field}'), 1, 8))"
            " AS BIGINT)")


def _pick(values, id_expr, field) -> str:
    return f"[{', '.join(S.lit(v) for v in values)}][1 + ({_h(id_expr, field)} % {len(values)})]"


def _rng(lo, hi, id_expr, field) -> str:
    return f"({lo} + {_h(id_expr, field)} % {hi - lo + 1})"


def synth_sql(src: str, id_col: str) -> str:
    """SELECT id, email_text FROM (G1 over ``src``)."""
    i = id_col
    vals = {
        "subject": _pick(G.SUBJECTS, i, "subject"), "name": _pick(G.NAMES, i, "name"),
        "sender": _pick(G.NAMES, i, "sender"), "company": _pick(G.COMPANIES, i, "company"),
        "store": _pick(G.STORES, i, "store"), "body": _pick(G.BODIES, i, "body"),
        "time": f"CAST({_rng(9, 17, i, 'time')} AS VARCHAR) || ':00'",
        "day": _pick(G.DAYS, i, "day"), "month": _pick(G.MONTHS, i, "month"),
        "quarter": _pick(G.QUARTERS, i, "quarter"),
        "date": (f"{_pick(G.DATE_DAYS, i, 'date_day')} || ', ' || CAST({_rng(1, 28, i, 'date_num')} AS VARCHAR)"
                 f" || ' ' || {_pick(G.DATE_MONTHS, i, 'date_month')}"),
        "number": f"CAST({_rng(100000, 999999, i, 'number')} AS VARCHAR)",
        "amount": (f"CAST({_rng(10, 500, i, 'amount')} AS VARCHAR) || '.' || "
                   f"lpad(CAST({_rng(0, 99, i, 'cents')} AS VARCHAR), 2, '0')"),
        "event": _pick(G.EVENTS, i, "event"),
    }
    cols = ", ".join(f"{v} AS v_{k}" for k, v in vals.items())
    x = "tmpl"
    for _ in range(2):
        for k in G.KEY_ORDER:
            x = f"replace({x}, '{{{k}}}', v_{k})"
    return (f"SELECT {i}, {x} AS email_text FROM (SELECT {i}, {_pick(G.TEMPLATES, i, 'template')} AS tmpl, {cols} "
            f"FROM {src}) gen")


_POS_SQL = "(SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)"


@register("synthetic_emails", synth_sql(_POS_SQL + " p", "doc_id"))
def synthetic_emails(spark, base):
    """One synthetic legitimate e-mail per positive document (seeded by its id)."""
    pos = labelled_documents(spark, base).where(F.col("label") == 1).select("doc_id")
    return G.generate(pos, "doc_id")


_CANDS_SQL = ("(SELECT d.doc_id * 2 + k AS cand_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id, "
              "range(2) r(k))")
_DISTINCT_SQL = f"""
WITH g AS ({synth_sql(_CANDS_SQL + ' c', 'cand_id')}),
f AS (SELECT cand_id, email_text, {S.fingerprint('email_text')} AS fp FROM g),
u AS (SELECT cand_id, email_text, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY cand_id) AS rn FROM f) x
      WHERE rn = 1),
n AS (SELECT count(*) AS n FROM {_POS_SQL} p)
SELECT cand_id, email_text, fp FROM (SELECT u.*, row_number() OVER (ORDER BY {S.hash_key('synthpick:42:', 'cand_id')},
       cand_id) AS rn FROM u) y, n WHERE rn <= n.n"""


@register("synthetic_distinct", _DISTINCT_SQL)
def synthetic_distinct(spark, base):
    """As many distinct synthetic e-mails as there are positive documents."""
    ld = labelled_documents(spark, base)
    n = ld.where(F.col("label") == 1).count()
    out = G.generate_distinct(ld.select("doc_id"), "doc_id", n)
    return G.check_count(materialize(out), n, "synthetic e-mails")


@register("boilerplate_rate", f"""
WITH g AS ({synth_sql(_POS_SQL + ' p', 'doc_id')})
SELECT 0 AS label, count(*) AS n,
       round(avg(CASE WHEN regexp_matches(email_text, {S.lit(A.GREETING_PATTERN)}) THEN 1.0 ELSE 0.0 END), 6) AS greeting_rate,
       round(avg(CASE WHEN regexp_matches(email_text, {S.lit(A.CLOSING_PATTERN)}) THEN 1.0 ELSE 0.0 END), 6) AS closing_rate,
       round(avg(CASE WHEN regexp_matches(email_text, {S.lit(A.NAME_PATTERN)}) THEN 1.0 ELSE 0.0 END), 6) AS names_rate,
       round(avg(CASE WHEN regexp_matches(email_text, {S.lit(A.GREETING_PATTERN)})
                        OR regexp_matches(email_text, {S.lit(A.CLOSING_PATTERN)})
                        OR regexp_matches(email_text, {S.lit(A.NAME_PATTERN)}) THEN 1.0 ELSE 0.0 END), 6) AS any_rate
FROM g""")
def boilerplate_rate(spark, base):
    """A5 over the synthetic negatives: formulaic greetings, closings and stock names."""
    neg = synthetic_emails(spark, base).withColumn("label", F.lit(0))
    return A.boilerplate_rate(neg, "email_text", ("label",))


# synthetic negatives and the cleaned positives they are to be told from
_AUDITED_SQL = CLEAN_LABELLED_SQL + f""",
audited AS (SELECT 0 AS label, email_text FROM ({synth_sql(_POS_SQL + ' p', 'doc_id')}) g
            UNION ALL SELECT label, email_text FROM uniq WHERE label = 1),
ls AS (SELECT row_number() OVER () AS rid, label, list_filter(list_filter(
         list_transform(string_split(email_text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''),
         lambda x, i: i > 1 OR NOT starts_with(x, 'Subject:')) AS rows FROM audited),
fr AS (SELECT rid, label, lower(regexp_extract(rows[1], '^(\\p{{L}}+)', 1)) AS opening,
         regexp_extract(rows[1], '^\\p{{L}}+ (\\p{{Lu}}\\p{{L}}+)', 1) AS addressee,
         CASE WHEN len(rows) >= 3 THEN rows[len(rows) - 1] END AS closing, CASE WHEN len(rows) >= 3 THEN rows[len(rows)] END AS signature
       FROM ls),
fv AS (SELECT rid, label, unnest(['opening', 'addressee', 'closing', 'signature']) AS frame,
         unnest([opening, addressee, closing, signature]) AS value FROM fr),
found AS (SELECT frame, value, count(*) AS n FROM fv WHERE coalesce(value, '') <> '' GROUP BY ALL
          HAVING count(*) >= CAST(0.02 AS DOUBLE) * (SELECT count(*) FROM fr)),
hit AS (SELECT rid, fv.label, frame, found.value IS NOT NULL AS hit FROM fv LEFT JOIN found USING (frame, value))"""


def audited_mail(spark, base):
    neg = synthetic_emails(spark, base).select("email_text", F.lit(0).alias("label"))
    rows = dedup_keep_first(clean_labelled(spark, base), "fp", "doc_id", scope=("label",))
    return neg.unionByName(rows.where(F.col("label") == 1).select("email_text", "label"))


@register("frequent_frames", _AUDITED_SQL + " SELECT frame, value, n FROM found")
def frequent_frames(spark, base):
    """A5: the openings, addressees, closings and signatures that repeat, as found in the mails."""
    return A.frequent_frames(audited_mail(spark, base), "email_text")


@register("found_boilerplate_rate", _AUDITED_SQL + """,
rowhit AS (SELECT rid, label, max(hit) AS any_hit FROM hit GROUP BY ALL),
per AS (SELECT label, frame, round(avg(CAST(hit AS INTEGER)), 6) AS rate FROM hit GROUP BY ALL)
SELECT label, count(*) AS n, (SELECT rate FROM per p WHERE p.label = r.label AND frame = 'opening') AS opening_rate,
       (SELECT rate FROM per p WHERE p.label = r.label AND frame = 'addressee') AS addressee_rate,
       (SELECT rate FROM per p WHERE p.label = r.label AND frame = 'closing') AS closing_rate,
       (SELECT rate FROM per p WHERE p.label = r.label AND frame = 'signature') AS signature_rate,
       round(avg(CAST(any_hit AS INTEGER)), 6) AS any_rate FROM rowhit r GROUP BY label""")
def found_boilerplate_rate(spark, base):
    """A5: how many mails of each class carry a frame that was found to repeat."""
    return A.found_boilerplate_rate(materialize(audited_mail(spark, base)), "email_text")


@register("balanced_corpus_rows", CLEAN_LABELLED_SQL + f""",
pos AS (SELECT doc_id, email_text FROM (SELECT doc_id, email_text, row_number() OVER (ORDER BY {S.hash_key('cap:42:', 'doc_id')}, doc_id) AS rn
        FROM uniq WHERE label = 1) c WHERE rn <= {positive_cap(2000, 1.0)}),
g AS ({synth_sql(_CANDS_SQL + ' c', 'cand_id')}),
f AS (SELECT cand_id, email_text, {S.fingerprint('email_text')} AS fp FROM g),
u AS (SELECT cand_id, email_text FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY cand_id) AS rn FROM f) x WHERE rn = 1),
neg AS (SELECT email_text, row_number() OVER (ORDER BY {S.hash_key('synthpick:42:', 'cand_id')}, cand_id) AS rn FROM u)
SELECT CAST(1 AS INTEGER) AS label, email_text FROM pos
UNION ALL SELECT 0, email_text FROM neg WHERE rn <= (SELECT count(*) FROM pos)""")
def balanced_corpus_rows(spark, base):
    """The labelled file itself, row by row, as it is read back."""
    return _balanced_file(spark, base).select("label", "email_text")


@register("balanced_corpus_job", CLEAN_LABELLED_SQL + f""",
pos AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {S.hash_key('cap:42:', 'doc_id')}, doc_id) AS rn
        FROM uniq WHERE label = 1) c WHERE rn <= {positive_cap(2000, 1.0)})
SELECT 1 AS label, count(*) AS n FROM pos
UNION ALL SELECT 0 AS label, count(*) AS n FROM pos""")
def balanced_corpus_job(spark, base):
    """Class counts (A1) of the labelled file."""
    return _balanced_file(spark, base).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _balanced_file(spark, base):
    """Cleaned, deduplicated, capped positives + as many distinct synthetic negatives, shuffled, written as
    the labelled CSV and read back."""
    rows = clean_labelled(spark, base).where(F.col("label") == 1)
    unique = dedup_keep_first(rows, "fp", "doc_id", scope=("label",))
    positives = materialize(cap_rows(unique, positive_cap(2000, 1.0), "doc_id")
                            .select("doc_id", "email_text", "label"))
    n_pos = positives.count()
    if n_pos == 0:
        raise RuntimeError("no positive rows could be processed")
    negatives = G.generate_distinct(labelled_documents(spark, base).select("doc_id"), "doc_id", int(n_pos * 1.0))
    negatives = negatives.select(F.col("cand_id").alias("doc_id"), "email_text", F.lit(0).alias("label"))
    corpus = seeded_shuffle(positives.unionByName(negatives), "doc_id")
    path = scratch_path(spark, "labelled-csv")
    write_labelled_csv(corpus, path)
    return read_labelled_csv(spark, path)
