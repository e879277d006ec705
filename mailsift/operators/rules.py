"""Rule layer (J4, J5, R1, R2): sender blacklist, look-alike domains, keyword rules and the
three-layer routing cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"

# FIXED VALUES: keyword rules for executive-fraud and credential wording (rule, pattern).
KEYWORD_RULES = (
    ("urgent_transfer", r"(?i)(urgent|urgente|asap).{0,40}(transfer|transferencia|wire|payment|pago)"),
    ("gift_cards", r"(?i)(gift ?cards?|tarjetas? de regalo)"),
    ("credentials", r"(?i)(verify|verifique|confirm|confirme|valide).{0,40}(account|cuenta|password|contraseña)"),
    ("executive", r"(?i)(ceo|cfo|director general|gerente general).{0,60}(request|solicita|need|necesito)"),
    ("suspension", r"(?i)(suspend|suspensión|suspension|locked|bloquead)"),
)


def host_of(url: Column | str) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(u, HOST_PATTERN, 1))


def blacklist_match(df: DataFrame, host_col: str, blacklist: DataFrame, list_col: str = "host") -> DataFrame:
    """Rows whose sender host is listed (left-semi join; AQE broadcasts the list when its
    measured bytes allow it)."""
    bl = blacklist.select(F.col(list_col).alias(host_col)).distinct()
    return df.join(bl, host_col, "left_semi")


def deletion_variants(s: Column, max_edits: int = 2) -> Column:
    """Every string obtained from ``s`` by deleting at most two characters (incl. ``s``)."""
    n = F.length(s)
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    one = F.transform(idx, lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, 1 << 20)))
    out = F.concat(F.array(s), one)
    if max_edits >= 2:
        two = F.flatten(F.transform(idx, lambda i: F.transform(
            F.filter(idx, lambda j: j > i),
            lambda j: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, j - i - 1),
                               F.substring(s, j + 1, 1 << 20)))))
        out = F.concat(out, two)
    return F.array_distinct(out)


def lookalike_pairs(hosts: DataFrame, trusted: DataFrame, host_col: str = "host",
                    max_distance: int = 2) -> DataFrame:
    """(host, trusted, distance) with 1 ≤ Levenshtein distance ≤ ``max_distance``.

    Exact blocking by deletion neighbourhoods: two strings within edit distance k share a
    string reachable by ≤ k deletions from each, so candidates are an equi-join on that
    variant (no pair enumeration inside a length group); every candidate is then verified
    with ``levenshtein``. Hosts that are themselves trusted are not flagged.
    """
    h = hosts.select(F.col(host_col).alias("host")).distinct()
    t = trusted.select(F.col(host_col).alias("trusted")).distinct()
    hv = h.select("host", F.explode(deletion_variants(F.col("host"), max_distance)).alias("v"))
    tv = t.select("trusted", F.explode(deletion_variants(F.col("trusted"), max_distance)).alias("v"))
    cand = hv.join(tv, "v").select("host", "trusted").distinct()
    cand = cand.join(t.select(F.col("trusted").alias("host")), "host", "left_anti")
    return (cand.withColumn("distance", F.levenshtein("host", "trusted").cast("bigint"))
            .where(F.col("distance").between(1, max_distance)))


def keyword_flags(text: Column | str, rules=KEYWORD_RULES) -> dict[str, Column]:
    """R2: one boolean per rule (literal patterns, compiled once per task)."""
    t = F.col(text) if isinstance(text, str) else text
    return {name: t.rlike(pat) for name, pat in rules}


def keyword_hits(df: DataFrame, text_col: str, rules=KEYWORD_RULES) -> DataFrame:
    """R2 report: documents matched per rule."""
    flags = keyword_flags(text_col, rules)
    agg = df.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    stack = ", ".join(f"'{n}', `{n}`" for n in flags)
    return agg.select(F.expr(f"stack({len(flags)}, {stack}) as (rule, n_matched)"))


def any_keyword(text: Column | str, rules=KEYWORD_RULES) -> Column:
    out = F.lit(False)
    for c in keyword_flags(text, rules).values():
        out = out | c
    return out


def route(blocked: Column, flagged: Column, lookalike: Column, p_positive: Column,
          hi: float = 0.9, lo: float = 0.1) -> tuple[Column, Column]:
    """Rules → classifier → explanation queue; each layer only decides what the
    earlier layers left open. Returns ``(decision, layer)`` columns."""
    decision = (F.when(blocked, F.lit("block"))
                .when(flagged | lookalike, F.lit("quarantine"))
                .when(p_positive >= hi, F.lit("block"))
                .when(p_positive <= lo, F.lit("deliver"))
                .otherwise(F.lit("explain_queue")))
    layer = (F.when(blocked | flagged | lookalike, F.lit("rules"))
             .when((p_positive >= hi) | (p_positive <= lo), F.lit("classifier"))
             .otherwise(F.lit("explanation")))
    return decision, layer
