"""Registered queries: rule layer and routing.

Senders are the hosts of ``pages.url``; the blacklist is the set of hosts of pages whose id
is a positive labelled document, the trusted list the hosts of pages labelled good quality
and non-toxic — both derived from the tables, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import clean_masked
from ..operators import rules as R
from ..operators.classify import nb_fit, nb_predict
from ..operators.compute import with_computed, with_html_text
from ..session import materialize
from ..sources.tables import pages, read_table
from . import sqltext as S
from .corpus import prepare_corpus
from .q_model import _nb_sql
from .registry import register

_HOST = f"lower(regexp_extract(url, {S.lit(R.HOST_PATTERN)}, 1))"
_PH = f"(SELECT page_id, {_HOST} AS host FROM pages)"
_BL = f"(SELECT DISTINCT p.host FROM {_PH} p JOIN labels l ON p.page_id = l.doc_id WHERE l.toxic = 1)"
_TR = f"(SELECT DISTINCT p.host FROM {_PH} p JOIN labels l ON p.page_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0)"
_LA = f"""(SELECT DISTINCT h.host, t.host AS trusted, levenshtein(h.host, t.host) AS distance
  FROM (SELECT DISTINCT host FROM {_PH} x) h, {_TR} t
  WHERE levenshtein(h.host, t.host) BETWEEN 1 AND 2 AND h.host NOT IN (SELECT host FROM {_TR} z))"""


def _hosts(spark, base):
    return pages(spark, base, "page_id", "url").select("page_id", R.host_of("url").alias("host"))


def _lists(spark, base):
    ph = _hosts(spark, base)
    lab = read_table(spark, base, "labels", "doc_id", "quality", "toxic")
    j = ph.join(lab, ph.page_id == lab.doc_id)
    bl = j.where(F.col("toxic") == 1).select("host").distinct()
    tr = j.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("host").distinct()
    return ph, bl, tr


@register("blacklist_match", f"SELECT page_id, host FROM {_PH} p WHERE host IN (SELECT host FROM {_BL} b)")
def blacklist_match(spark, base):
    """Pages whose sender host is on the (derived) blacklist."""
    ph, bl, _ = _lists(spark, base)
    return R.blacklist_match(ph, "host", bl)


@register("lookalike_domains", f"SELECT host, trusted, distance FROM {_LA} la")
def lookalike_domains(spark, base):
    """Hosts within edit distance 1–2 of a trusted host (exact, deletion-blocked)."""
    ph, _, tr = _lists(spark, base)
    return R.lookalike_pairs(ph, tr)


_RULES_SQL = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE regexp_matches(text, {S.lit(p)})) AS n_matched FROM documents"
    for n, p in R.KEYWORD_RULES)


@register("keyword_rules", _RULES_SQL)
def keyword_rules(spark, base):
    """R2: documents matched per keyword rule."""
    d = read_table(spark, base, "documents", "text", parallel=True)
    return R.keyword_hits(d, "text")


_ANY_RULE = " OR ".join(f"regexp_matches(body, {S.lit(p)})" for _, p in R.KEYWORD_RULES)


@register("layered_routing", _nb_sql(1.0) + f""",
pb AS (SELECT page_id, {_HOST} AS host, {S.clean_masked(S.html_to_text('html', 'masked'))} AS body FROM pages),
ptok AS (SELECT page_id, unnest(regexp_extract_all(lower(body), '{P.TOKEN_PATTERN}')[1:{P.MAX_TOKENS}]) AS token FROM pb),
ptf AS (SELECT page_id, token, count(*) AS tf FROM ptok GROUP BY page_id, token),
psum AS (SELECT page_id, sum(tf * lp_0) AS s0, sum(tf * lp_1) AS s1 FROM ptf JOIN model USING (token) GROUP BY page_id),
psc AS (SELECT pb.page_id, pr0 + coalesce(s0, 0.0) AS s0, pr1 + coalesce(s1, 0.0) AS s1 FROM pb LEFT JOIN psum USING (page_id), pri),
pp AS (SELECT page_id, exp(s1 - greatest(s0, s1)) / (exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))) AS p1 FROM psc),
fl AS (SELECT pb.page_id, pb.host IN (SELECT host FROM {_BL} b) AS blocked, ({_ANY_RULE}) AS flagged,
              pb.host IN (SELECT host FROM {_LA} l) AS lookalike, pp.p1 FROM pb JOIN pp USING (page_id))
SELECT page_id,
       CASE WHEN blocked THEN 'block' WHEN flagged OR lookalike THEN 'quarantine' WHEN p1 >= 0.9 THEN 'block'
            WHEN p1 <= 0.1 THEN 'deliver' ELSE 'explain_queue' END AS decision,
       CASE WHEN blocked OR flagged OR lookalike THEN 'rules' WHEN p1 >= 0.9 OR p1 <= 0.1 THEN 'classifier'
            ELSE 'explanation' END AS layer
FROM fl""")
def layered_routing(spark, base, model=None):
    """Blacklist / keyword / look-alike rules, then the naive Bayes classifier for what no rule
    decides, and the undecided rest to the explanation queue. The host rules come first: a page they
    decide is never converted. ``model`` is a fitted (token table, priors); without it one is fitted."""
    ph, bl, tr = _lists(spark, base)
    la = materialize(R.lookalike_pairs(ph, tr).select("host").distinct().withColumn("_la", F.lit(True)))
    blk = materialize(bl.withColumn("_bl", F.lit(True)))
    hosts = materialize(ph.join(blk, "host", "left").join(la, "host", "left").select(
        "page_id", F.coalesce("_bl", F.lit(False)).alias("blocked"), F.coalesce("_la", F.lit(False)).alias("lookalike")))
    undecided = hosts.where(~(F.col("blocked") | F.col("lookalike"))).select("page_id")
    body = with_computed(with_html_text(pages(spark, base, "page_id", "html").join(undecided, "page_id"), "html", "_text"),
                         body=clean_masked("_text"))
    read = materialize(body.select("page_id", "body", R.any_keyword("body").alias("flagged")))
    if model is None:
        corpus = prepare_corpus(spark, base)
        model = nb_fit(corpus.where(F.col("part") == "train"), "email_text", "label", 1.0)
    open_ = read.where(~F.col("flagged"))
    p = nb_predict(open_.select(F.col("page_id").alias("doc_id"), "body"), *model, "body") \
        .select(F.col("doc_id").alias("page_id"), "p_1")
    rows = hosts.join(read.drop("body"), "page_id", "left").join(p, "page_id", "left") \
        .withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    decision, layer = R.route(F.col("blocked"), F.col("flagged"), F.col("lookalike"), F.col("p_1"))
    return rows.select("page_id", decision.alias("decision"), layer.alias("layer"))
