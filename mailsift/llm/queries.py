"""One registered query per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontam, langid, lines, minhash, pii, quality, runs, secret_scan, shards,
               token_counts, trie, winnow)
from .common import table, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
SHARDS = 16


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The components by all pairs that share a shingle: for tables of the size of a check.
ORACLES["op3_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws
                     FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
      FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id
      GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents
                     UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, reach.doc_id = min(r) AS kept
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id"""

ORACLES["op8_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {lines.MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
f AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _sha(text) -> F.Column:
    return F.sha2(text, 256)


def _listed(spans, fmt="kind:start:end") -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *[s[x].cast("string") for x in fmt.split(":")])),
                        ",")


def _count(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                         public_tokenizers.path(BYTE_BPE), decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha("decoded").alias("decoded_sha256"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"),
                               table(spark, sf_dir, "benchmark"))


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 public_tokenizers.path(PIECE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *map(_count, secret_scan.BASE_KINDS), _sha(_listed(base)).alias("base_sha256"),
                        _listed("spans").alias("spans"), "n_live", "n_shared",
                        _listed("spans", "n_owners:n_repositories").alias("span_counts"))


@query
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = shards.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn_profiles(docs.where(~langid.held_out("doc_id")))
    return langid.predict_language(docs.select("doc_id", "text"), profiles) \
        .select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *map(_count, pii.BASE_KINDS), _sha(_listed(base)).alias("base_sha256"),
                        _listed("spans").alias("spans"),
                        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(written(quality.quality_stats(docs), "quality-stats"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", "p_good")


@query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(prints):
        return F.array_join(F.transform(prints, lambda p: F.concat_ws(
            ":", F.lower(F.lpad(F.hex(p["hash"]), 16, "0")), p["position"].cast("string"))), ",")
    return found.select("doc_id", "n_chars", _sha("edited").alias("edited_sha256"), listed("prints").alias("fingerprint"),
                        listed("edited_prints").alias("edited_fingerprint"), "near_edited", "near_next")


def _with_periods(docs: DataFrame) -> DataFrame:
    """Of documents with crc32(doc_id) % 10 = 0, the words from the a-th on repeat the p words that stand there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bound = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise("")), 1)
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), bound).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # strictly greater by cross-multiplication: of equal ones the first, by start, then period, stays
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)),
                       lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines_ = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        _sha(lines_).alias("runs_sha256"), _sha("collapsed").alias("collapsed_sha256"))


#: Conversations of a family begin with turns of its first; a family has so many ids.
FAMILY = 5


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.identified(table(spark, sf_dir, "conversations"))
    own = written(trie.numbered(turns, [F.col("turn").asc_nulls_first()], "number")
                  .select("conv", "number", "role", "h1", "h2", "n_bytes"), "trie-turns")
    convs = written(own.select("conv").distinct(), "trie-conversations")
    head = F.crc32(F.col("conv").cast("string")) % 9
    first = F.col("conv") - F.pmod("conv", F.lit(FAMILY))
    given = convs.where((first != F.col("conv")) & (head > 0)).select(F.col("conv").alias("to"), head.alias("h"), first.alias("conv")) \
        .join(own.where((F.pmod("conv", F.lit(FAMILY)) == 0) & (F.col("number") < 9)), "conv").where("number <= h") \
        .select(F.col("to").alias("conv"), F.lit(0).alias("part"), "number", "role", "h1", "h2", "n_bytes")
    rest = own.where((first == F.col("conv")) | (F.col("number") > head)) \
        .select("conv", F.lit(1).alias("part"), "number", "role", "h1", "h2", "n_bytes")
    return trie.prefix_trie(given.unionByName(rest), [F.col("part"), F.col("number")], convs)
