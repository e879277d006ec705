"""Secrets, and how widely each is owned (native).

Candidates come from one leftmost, non-overlapping scan per kind; their positions are running sums
over the text between matches. Every candidate value is hashed, and over the whole corpus the
distinct repositories (by default the documents) and distinct owners (by default the sources) that
show the hash are counted. A value that many owners or many repositories show is an example that was
copied around, be it by a single owner; a value of few owners and few repositories looks live. Each
span tells both counts of its value.

The kinds ``assign``, ``access`` and ``hex`` are the base. ``vendor`` (tokens with a provider's
prefix) and ``pem`` (private key headers) are added by the method.

Null or empty text: no spans. Null ids and owners are values like any other; repeated rows (same id
and text) count once in the frequencies. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.compute import with_computed
from .common import written

# The patterns of the kinds and the group that holds the secret.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "vendor": r"(?:gh[oprsu]_|glpat-|xox[abprs]-|sk-|AIza)[A-Za-z0-9_-]{16,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
BASE_KINDS = ("assign", "access", "hex")
MIN_ASSIGNED = 6
#: Owners from which on a value counts as a copied example.
SHARED_OWNERS = 3
#: Repositories from which on it does, whoever owns them.
SHARED_REPOSITORIES = 10
#: Tasks over which the documents that hold one value are dealt.
SALTS = 16


_COUNTS = "array<struct<start:bigint,kind_order:int,n_owners:bigint,n_repositories:bigint>>"


def _value(kind: str, hit: Column) -> Column:
    return F.regexp_extract(hit, PATTERNS[kind], 1) if kind == "assign" else hit


def _spans(kind: str, order: int, text: Column, hits: Column) -> Column:
    """Structs (start, order, end, kind, value) of the hits that count."""
    walk = F.aggregate(
        F.zip_with(F.split(text, PATTERNS[kind], -1), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))),
        F.struct(F.lit(0).cast("bigint").alias("at"),
                 F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string,value:string>>")
                 .alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("bigint").alias("at"),
            F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).cast("bigint").alias("start"), F.lit(order).alias("kind_order"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).cast("bigint").alias("end"),
                F.lit(kind).alias("kind"), _value(kind, x["hit"]).alias("value"))))).alias("found")))["found"]
    if kind == "assign":
        walk = F.filter(walk, lambda s: F.length(s["value"]) >= MIN_ASSIGNED)
    return F.when(F.size(hits) > 0, walk)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """``(id, owner, text_hash, spans)``: all spans by start, then kind as listed. Narrow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), F.col(owner_col).alias("_owner"), text.alias("_text"))
    hits = with_computed(base, **{f"_hits_{k}": F.regexp_extract_all("_text", F.lit(p), F.lit(0))
                                  for k, p in PATTERNS.items()})
    none = F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string,value:string>>")
    spans = F.array_sort(F.concat(*[F.coalesce(_spans(k, n, F.col("_text"), F.col(f"_hits_{k}")), none)
                                    for n, k in enumerate(PATTERNS)]))
    return hits.select(F.col("_id").alias(id_col), F.col("_owner").alias("owner"),
                       F.xxhash64("_text").alias("text_hash"), spans.alias("spans"))


def candidates(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per distinct (id, text, span), with the hash of its value."""
    return scanned.select(id_col, "owner", "text_hash", F.explode("spans").alias("s")) \
        .select(id_col, "owner", "text_hash", F.col("s.kind").alias("kind"), F.col("s.start").alias("start"),
                F.col("s.kind_order").alias("kind_order"), F.sha2("s.value", 256).alias("value_sha256")).distinct()


def ownership(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(value_sha256, n_owners, n_repositories)`` over the whole corpus: distinct ids, then owners,
    then values, each step summed before its shuffle."""
    per_owner = found.select("value_sha256", "owner", id_col).distinct() \
        .groupBy("value_sha256", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("value_sha256").agg(F.count(F.lit(1)).alias("n_owners"),
                                                 F.sum("n").alias("n_repositories"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """``(id, spans, n_live, n_shared)``, one row per row of ``docs``: its secrets with the owners and
    repositories of each value, how many look live and how many are widely copied."""
    scanned = written(scan(docs, id_col, text_col, owner_col), "secret-spans")
    found = candidates(scanned, id_col)
    # a span's start and kind tell it from the others of its text, and sort it like ``spans``
    # a value that stands in many documents is dealt over salts, so that its rows do not meet in one task
    owned = ownership(found, id_col).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64(id_col, "text_hash"), F.lit(SALTS)).cast("int"))
    judged = found.join(owned, ["value_sha256", "salt"]) \
        .groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_text_hash")) \
        .agg(F.array_sort(F.collect_set(F.struct("start", "kind_order", "n_owners", "n_repositories"))).alias("_counts"))
    spans = F.zip_with("spans", F.coalesce("_counts", F.array().cast(_COUNTS)), lambda s, c: F.struct(
        *[s[x].alias(x) for x in ("start", "kind_order", "end", "kind", "value")],
        c["n_owners"].alias("n_owners"), c["n_repositories"].alias("n_repositories")))
    shared = lambda s: (s["n_owners"] >= shared_owners) | (s["n_repositories"] >= shared_repositories)
    out = scanned.join(judged, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text_hash")),
                       "left").select(id_col, spans.alias("spans"))
    return out.select(id_col, "spans", F.size(F.filter("spans", lambda s: ~shared(s))).cast("bigint").alias("n_live"),
                      F.size(F.filter("spans", shared)).cast("bigint").alias("n_shared"))
