"""Exact "first *n* rows by a hash order" without a global sort or a full shuffle.

``flag_first_n`` marks the rows whose ``(key, tie)`` is among the ``cap`` smallest of their
partition (``partition_cols``, e.g. the class label). It never ranks the whole table:

1. a histogram of rows per ``(partition, bucket)``, bucket = first ``prefix_len`` hex digits
   of the key, is computed with a partial/final aggregation and brought to the driver — at
   most 16^prefix_len rows per partition value, whatever the size of the data;
2. from it the driver finds, per partition value, the one bucket holding the cut and the
   rank ``k`` of the cut inside it (plain integer arithmetic on the histogram, so the cap
   rule is evaluated exactly as written, e.g. ``int(n * ratio)``);
3. if such a bucket still holds more than ``max_rank_rows`` rows it is split by a histogram
   over four more hex digits (a filtered scan), until it does not; then only its rows are
   ranked, and the ``k``-th ``(key, tie)`` of each is fetched — one row per partition value;
4. every row is then compared with its partition's cut by a literal predicate: no join and
   no shuffle of the data.

``partition_cols`` must be a low-cardinality key (a class label, a language).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CapSpec = int | Callable[[dict], dict]


def _match(pcols: list[str], p: tuple, key: str, prefix: str) -> Column:
    cond = F.substring(F.col(key), 1, len(prefix)) == F.lit(prefix)
    for col, v in zip(pcols, p):
        cond = cond & F.col(col).eqNullSafe(F.lit(v))
    return cond


def _walk(buckets, k: int):
    """First bucket (in key order) where the running count reaches ``k``:
    ``(bucket, rank inside it, rows in it)``."""
    before = 0
    for bucket, n in sorted(buckets):
        if before + n >= k:
            return bucket, k - before, n
        before += n
    raise AssertionError("cap exceeds the histogram")


def _cuts(df: DataFrame, key: str, tie: str, cap: CapSpec, pcols: list[str], prefix_len: int,
          max_rank_rows: int):
    """Per partition value: ``(mode, cut_key, cut_tie)`` with mode in all / none / cut."""
    # a row without an order key (null id) is never among the first n
    rows = df.where(F.col(key).isNotNull())
    b = "_fb_bucket"
    hist = (rows.groupBy(*pcols, F.substring(F.col(key), 1, prefix_len).alias(b))
            .agg(F.count(F.lit(1)).alias("n")).collect())
    per: dict[tuple, list] = {}
    for r in hist:
        per.setdefault(tuple(r[c] for c in pcols), []).append((r[b], r["n"]))
    totals = {p: sum(n for _, n in v) for p, v in per.items()}
    caps = cap(totals) if callable(cap) else {p: int(cap) for p in totals}
    modes, edges = {}, {}
    for p, buckets in per.items():
        c = int(caps.get(p, 0))
        if c <= 0:
            modes[p] = ("none", None, None)
        elif c >= totals[p]:
            modes[p] = ("all", None, None)
        else:
            edges[p] = _walk(buckets, c)
    # refine: an edge bucket with more than max_rank_rows rows is split by 4 more hex digits
    # (a filtered histogram of that bucket only) until the rows to rank are few
    while True:
        hot = {p: e for p, e in edges.items() if e[2] > max_rank_rows and len(e[0]) < 32}
        if not hot:
            break
        sel = None
        for p, (prefix, _, _) in hot.items():
            m = _match(pcols, p, key, prefix)
            sel = m if sel is None else sel | m
        width = max(len(e[0]) for e in hot.values()) + 4
        sub = (rows.where(sel).groupBy(*pcols, F.substring(F.col(key), 1, width).alias(b))
               .agg(F.count(F.lit(1)).alias("n")).collect())
        grouped: dict[tuple, list] = {}
        for r in sub:
            grouped.setdefault(tuple(r[c] for c in pcols), []).append((r[b], r["n"]))
        for p, (_, k, _) in hot.items():
            edges[p] = _walk(grouped[p], k)
    if edges:
        sel, k_of = None, F.lit(None).cast("bigint")
        for p, (prefix, k, _) in edges.items():
            m = _match(pcols, p, key, prefix)
            sel = m if sel is None else sel | m
            k_of = F.when(m, F.lit(k)).otherwise(k_of)
        w = (Window.partitionBy(*pcols) if pcols else Window.partitionBy()).orderBy(F.col(key), F.col(tie))
        cut_rows = (rows.where(sel).withColumn("_fb_rn", F.row_number().over(w))
                    .where(F.col("_fb_rn") == k_of).select(*pcols, key, tie).collect())
        for r in cut_rows:
            modes[tuple(r[c] for c in pcols)] = ("cut", r[key], r[tie])
    return modes


def flag_first_n(df: DataFrame, key: str, tie: str, cap: CapSpec, flag: str,
                 partition_cols: tuple[str, ...] = (), prefix_len: int = 4,
                 max_rank_rows: int = 1_000_000) -> DataFrame:
    """Add boolean ``flag``: row is among the first ``cap`` of its partition by (key, tie).

    ``cap`` is an int, or a function ``{partition_value_tuple: total} -> {partition: cap}``
    (e.g. negatives = int(positives × ratio)). ``key`` must be a fixed-width hex string (an
    md5); ``tie`` must be unique (a row id) so that the order is total. At most
    ``max_rank_rows`` rows per partition value are ever ranked in one window partition: a
    larger edge bucket is first split by a histogram over the next hex digits.
    """
    pcols = list(partition_cols)
    modes = _cuts(df, key, tie, cap, pcols, prefix_len, max_rank_rows)
    kept: Column = F.lit(False)
    for p, (mode, ck, ct) in modes.items():
        if mode == "none":
            continue
        hit = F.lit(True)
        for col, v in zip(pcols, p):
            hit = hit & F.col(col).eqNullSafe(F.lit(v))
        if mode == "all":
            kept = F.when(hit, F.lit(True)).otherwise(kept)
        else:
            below = (F.col(key) < F.lit(ck)) | ((F.col(key) == F.lit(ck)) & (F.col(tie) <= F.lit(ct)))
            kept = F.when(hit, below).otherwise(kept)
    return df.withColumn(flag, F.coalesce(kept, F.lit(False)))


def first_n(df: DataFrame, key: str, tie: str, cap: CapSpec,
            partition_cols: tuple[str, ...] = (), **kw) -> DataFrame:
    """Keep only the first ``cap`` rows per partition (exact, hash-ordered)."""
    return (flag_first_n(df, key, tie, cap, "_fn_keep", partition_cols, **kw)
            .where("_fn_keep").drop("_fn_keep"))


def global_position(df: DataFrame, key: str, tie: str, out: str = "pos",
                    partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """1-based position of every row in ``(key, tie)`` order, per partition, without a
    single-partition window; null keys come first.

    Rows are range-partitioned by (partition, key, tie) and written with the number of their range,
    ranked inside their range, and offset by the rows of all earlier ranges. ``(key, tie)`` is
    unique, so no key makes a range large, and the driver sees one count per range and partition.
    """
    from pyspark.sql import types as T

    from ..session import materialize
    pcols = list(partition_cols)
    order = [F.col(c).asc_nulls_first() for c in [*pcols, key, tie]]
    ranges = materialize(df.repartitionByRange(*order).withColumn("_gp_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(*pcols, "_gp_range").agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, running = [], {}
    for r in sorted(counts, key=lambda r: r["_gp_range"]):
        p = tuple(r[c] for c in pcols)
        offsets.append((*p, r["_gp_range"], running.get(p, 0)))
        running[p] = running.get(p, 0) + r["n"]
    schema = T.StructType([T.StructField(f"_gp_{k}", df.schema[c].dataType) for k, c in enumerate(pcols)]
                          + [T.StructField("_gp_at", T.IntegerType()), T.StructField("_gp_before", T.LongType())])
    before = df.sparkSession.createDataFrame(offsets, schema)
    inside = Window.partitionBy(*pcols, "_gp_range").orderBy(F.col(key), F.col(tie))
    at = F.col("_gp_range") == F.col("_gp_at")
    for k, c in enumerate(pcols):
        at = at & F.col(c).eqNullSafe(F.col(f"_gp_{k}"))
    return (ranges.join(F.broadcast(before), at)
            .withColumn(out, F.col("_gp_before") + F.row_number().over(inside))
            .drop("_gp_range", "_gp_at", "_gp_before", *[f"_gp_{k}" for k in range(len(pcols))]))
