"""Deterministic orders and draws from hashes.

Spark's ``rand()`` depends on partitioning; an md5 of ``salt + id`` does not, so the same
rows are drawn on 8 threads, on 1,000 executors and in the SQL oracle. Each stage uses its
own salt so that stages are independent (sampling and splitting must not correlate).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def salt(stage: str, seed: int = P.SEED) -> str:
    return f"{stage}:{seed}:"


def hash_key(stage: str, id_col, seed: int = P.SEED) -> Column:
    """32-hex-digit order key of a row for ``stage`` (compare as strings)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(salt(stage, seed)), c.cast("string")))


def hash_int(stage: str, id_col, field: str, seed: int = P.SEED) -> Column:
    """A non-negative 32-bit integer drawn for ``field`` of a row (first 8 hex digits)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(F.lit(salt(stage, seed)), c.cast("string"), F.lit(":" + field)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def pick(values, stage: str, id_col, field: str, seed: int = P.SEED) -> Column:
    """Choose one element of a fixed list for a row (uniform over the list)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (hash_int(stage, id_col, field, seed) % len(values) + 1).cast("int"))


def draw_range(lo: int, hi: int, stage: str, id_col, field: str, seed: int = P.SEED) -> Column:
    """An integer in ``[lo, hi]`` for a row."""
    return (F.lit(lo) + hash_int(stage, id_col, field, seed) % (hi - lo + 1)).cast("bigint")
