"""From raw documents to token ids: filter, deduplicate, decontaminate, encode.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``.

- quality: documents that the rules' posterior rejects go.
- line_dedup: repeated lines are cut from the texts.
- near_dedup: of each group of near copies (five-word shingles, similarity 0.8) one stays.
- decontaminate: documents with a benchmark passage go.
- bpe: token ids of what is left, checked by decoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import bpe, decontam, lines, minhash, quality
from mailsift.llm.common import table, written

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(docs, counts=False)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``; ``round_trip`` tells whether the decoded ids hash to
    the same text."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("doc_id", F.xxhash64(text).alias("text_hash")).alias("key"), "text")
    encoded = bpe.encode(keyed, public_tokenizers.path(TOKENIZER), id_col="key", decoded=True)
    return encoded.select("key.doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                          (F.xxhash64("decoded") == F.col("key.text_hash")).alias("round_trip"))


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("bpe", bpe_encode)]

#: Neither the fitted posteriors, the components nor the ids can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
