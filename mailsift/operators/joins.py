"""Equi-joins with frequent keys.

A token that stands in every document makes a join by token wait for the one task that gets all its
rows, and adaptive execution cannot split a side that comes from an aggregation. Here a key that holds
more than a task's fair share is cut into pieces: its rows on the large side are dealt to the pieces by
a hash, its rows on the other side are repeated for each piece, and the join is by key and piece.
All other keys have one piece, so the join reads both sides once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A frequent key has more than 1 / (SHARES * shuffle partitions) of the rows.
SHARES = 4
#: With fewer rows than this a key is never frequent.
LEAST = 1000

Heavy = list[tuple[tuple, int]]


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_of_counts(counts: DataFrame, keys: list[str], n_col: str, least: int = LEAST) -> Heavy:
    """The frequent keys and their pieces from a table of rows per key: at most SHARES times as many
    as there are shuffle partitions."""
    total = counts.agg(F.sum(n_col)).first()[0] or 0
    share = max(total / (SHARES * _tasks(counts)), least)
    return [(tuple(r[c] for c in keys), math.ceil(r[n_col] / share))
            for r in counts.where(F.col(n_col) > share).select(*keys, n_col).collect()]


def heavy_of_shares(table: DataFrame, keys: list[str], share_col: str) -> Heavy:
    """The frequent keys and their pieces from a table of each key's share of the rows."""
    tasks = SHARES * _tasks(table)
    return [(tuple(r[c] for c in keys), math.ceil(r[share_col] * tasks))
            for r in table.where(F.col(share_col) * tasks > 1).select(*keys, share_col).collect()]


def split_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: Heavy, deal_by: list[str],
               how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` by ``keys``; the rows of ``heavy`` keys in ``left`` are dealt to
    their pieces by a hash of ``deal_by``, null keys (which match nothing) to as many pieces as tasks."""
    spark = left.sparkSession
    schema = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in keys) + ", _pieces int"
    known = F.broadcast(spark.createDataFrame([(*k, p) for k, p in heavy], schema))     # bounded by heavy_*
    absent = F.lit(False)
    for c in keys:
        absent = absent | F.col(c).isNull()
    pieces = F.coalesce("_pieces", F.when(absent, F.lit(_tasks(left))), F.lit(1))
    dealt = left.join(known, keys, "left").withColumn("_piece", F.pmod(F.xxhash64(*deal_by), pieces).cast("int")).drop("_pieces")
    repeated = right.join(known, keys, "left") \
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(repeated, [*keys, "_piece"], how).drop("_piece")
