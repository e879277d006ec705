"""Document fingerprints by winnowing.

Every run of ``K`` code points (a k-gram) has a rolling hash: prefix sums of ``value(c_t) * B^t``
modulo 2^64, whose difference over a run times ``B^-start`` depends on the run alone. Of every
``WINDOW`` consecutive k-grams the smallest hash is a fingerprint, of equal ones the rightmost;
neighbouring windows mostly choose the same one, so about ``2 / (WINDOW + 1)`` of the k-grams stay.
Hash and position are kept. A passage of ``K + WINDOW - 1`` code points that two texts share holds a
whole window and thus a common fingerprint, whatever surrounds it, and nothing shorter than ``K``
code points matches. The smallest is chosen by the upper 32 bits of the 64-bit hash.

``fingerprints`` reads each document once and moves nothing. ``edited_fingerprints`` compares each
document with the next one in descending id order and with its own edited text: the last third of
its code points replaced by the first as many of the next text. For it the texts are shuffled once:

1. a pass over (id, hash of the text) finds the first key of each range of the order, one row per
   range on the driver;
2. a document goes to the range of its key, and the first of a range also, as a guest, to the range
   before it (the first of all to the last range);
3. a task reads its ranges in order, one block of rows at a time, and each row finds its successor
   behind it.

Texts shorter than ``K`` are one k-gram; with fewer than ``WINDOW`` k-grams all of them are one window.
Null and empty texts have no fingerprint. Likeness is the Jaccard index of the two sets of hashes;
two empty sets are alike (1). Null ids come last, rows with one id follow by the hash of their texts,
then by the text; a single row is its own successor. Every input row gives one row, and columns other
than id and text are not read. Rows equal in id and text go to one range and are streamed there, never
held at once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix, seeds, texts

K = 24
WINDOW = 64
#: Cells hashed at once, and characters of the rows compared at once.
CHUNK = 1 << 18
BLOCK_CHARS = 1 << 20
#: Ranges of the order per shuffle partition.
RANGES = 4

PRINTS = "array<struct<hash:bigint,position:bigint>>"
_PRINT_TYPE = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))
_LOW = np.uint64(0xFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Winnower:
    """Fingerprints of lists of texts."""

    def __init__(self, k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        base = int(seeds(1, 61, odd=True)[0])
        self.salt = seeds(1, 62)[0]
        n = CHUNK + k + window
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 2**64), n)

    def _hashes(self, cells: np.ndarray) -> np.ndarray:
        """The hash of the k-gram that starts at each cell (the last ``k`` - 1 have none)."""
        with np.errstate(over="ignore"):
            values = mix(cells.astype(np.uint64) + self.salt) * self.up[:len(cells)]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
            return mix((sums[self.k:] - sums[:-self.k]) * self.down[:len(cells) - self.k + 1])

    def _least(self, keys: np.ndarray) -> np.ndarray:
        """The least key of every window."""
        span = 1
        while 2 * span <= self.window:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
        rest = self.window - span
        return np.minimum(keys[:-rest], keys[rest:]) if rest else keys

    def of(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, hashes, positions): the prints of row i lie at ``bounds[i]:bounds[i + 1]``."""
        pad = "\0" * (self.k + self.window)
        cells = np.frombuffer((pad.join(rows) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.array([len(t) for t in rows], np.int64)
        begin = np.cumsum(n + len(pad)) - (n + len(pad))
        grams = np.where(n >= self.k, n - self.k + 1, np.minimum(n, 1))
        windows = np.where(grams > 0, np.maximum(grams - self.window, 0) + 1, 0)
        is_gram, is_window = (self._marks(begin, m, len(cells)) for m in (grams, windows))
        found = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        last = -1
        for a in range(0, len(cells), CHUNK):
            part = cells[a:a + CHUNK + self.k + self.window - 2]
            if len(part) < self.k + self.window - 1:
                break
            hashes = self._hashes(part)
            place = np.arange(len(hashes), dtype=np.uint64)
            keys = (hashes & ~_LOW) | (_LOW - place)
            keys[~is_gram[a:a + len(hashes)]] = ~np.uint64(0)
            least = self._least(keys)[:CHUNK]
            chosen = (_LOW - (least[is_window[a:a + len(least)]] & _LOW)).astype(np.int64)
            chosen = chosen[np.diff(chosen, prepend=last - a) != 0]      # neighbours often choose the same
            if len(chosen):
                last = a + int(chosen[-1])
                found.append((hashes[chosen], a + chosen))
        hashes, at = (np.concatenate(x) for x in zip(*found))
        bounds = np.append(np.searchsorted(at, begin), len(at))
        row = np.repeat(np.arange(len(rows)), np.diff(bounds))
        with np.errstate(over="ignore"):        # a text shorter than k is hashed with its length
            short = n[row] < self.k
            hashes[short] = mix(hashes[short] + n[row][short].astype(np.uint64))
        return bounds, hashes, at - begin[row]

    @staticmethod
    def _marks(begin: np.ndarray, many: np.ndarray, size: int) -> np.ndarray:
        edges = np.zeros(size + 1, np.int8)
        some = many > 0
        edges[begin[some]] += 1
        edges[begin[some] + many[some]] -= 1
        return np.cumsum(edges[:-1], dtype=np.int8).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two arrays of hashes as sets."""
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def _print_array(bounds: np.ndarray, hashes: np.ndarray, positions: np.ndarray) -> pa.Array:
    cells = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(positions)], ["hash", "position"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), cells)


def _blocks(rows: Iterator, size, limit: int = BLOCK_CHARS) -> Iterator[list]:
    """Consecutive rows in lists of about ``limit`` characters."""
    block, chars = [], 0
    for r in rows:
        block.append(r)
        chars += size(r)
        if chars >= limit:
            yield block
            block, chars = [], 0
    if block:
        yield block


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 window: int = WINDOW) -> DataFrame:
    """``(id, n_chars, prints array<struct<hash, position>>)``, one row per row of ``docs``."""

    def run(batches):
        winnower = Winnower(k, window)
        for batch in batches:
            rows, at = texts(batch, "_text"), 0
            for block in _blocks(iter(rows), len):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(at, len(block)), pa.array([len(t) for t in block], pa.int64()),
                     _print_array(*winnower.of(block)).cast(_PRINT_TYPE)], ["_id", "n_chars", "prints"])
                at += len(block)

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                      f"_id {kind}, n_chars bigint, prints {PRINTS}")
    return out.withColumnRenamed("_id", id_col)


def _order_key() -> Column:
    """Descending, this puts the largest id first, null ids last and one id's texts by their hash."""
    return F.struct(F.col("_id"), F.bitwise_not(F.xxhash64(F.coalesce("_text", F.lit("")))).alias("_hash"))


def _range_of(key: Column, heads: Column, n: int) -> Column:
    """The number of the last of ``n`` descending ``heads`` that is not less than ``key`` (binary search)."""
    steps = [F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*steps), F.lit(0),
                       lambda at, s: F.when((at + s < n) & (F.get(heads, at + s) >= key), at + s).otherwise(at))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                        window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(id, n_chars, edited, prints, edited_prints, near_edited, near_next)``, one row per row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_chars bigint, edited string, prints {PRINTS}, edited_prints {PRINTS}, " \
             "near_edited double, near_next double"
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_key", _order_key())
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = keyed.select("_key").repartitionByRange(ranges, F.col("_key").desc()).groupBy(F.spark_partition_id()) \
        .agg(F.max("_key").alias("head")).orderBy(F.col("head").desc()).collect()       # a row per range
    heads = [r["head"] for r in heads]
    if not heads:
        return spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    listed = F.array(*[F.struct(F.lit(h["_id"]).cast(kind).alias("_id"), F.lit(h["_hash"]).cast("bigint").alias("_hash"))
                       for h in heads])
    n = len(heads)
    put = keyed.withColumn("_own", _range_of(F.col("_key"), listed, n))
    own = F.struct(F.col("_own").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("_own") - 1, F.lit(n)).alias("range"), F.lit(True).alias("guest"))
    put = put.withColumn("_put", F.explode(F.when(F.get(listed, F.col("_own")).eqNullSafe(F.col("_key")),
                                                  F.array(own, guest)).otherwise(F.array(own))))
    dealt = put.select("_id", "_text", "_key", F.col("_put.range").alias("_range"), F.col("_put.guest").alias("_guest")) \
        .repartition("_range").sortWithinPartitions("_range", "_guest", F.col("_key").desc(),
                                                    F.col("_text").asc_nulls_first())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        winnower = Winnower(k, window)

        def compared(rows):
            """The rows but the last one, each with its successor."""
            own = [t for _, _, _, t in rows]
            bounds, hashes, positions = winnower.of(own)
            mine = [i for i in range(len(rows) - 1) if not rows[i][2]]
            assert all(rows[i][1] == rows[i + 1][1] for i in mine)
            edited = []
            for i in mine:
                part = len(own[i]) // 3
                edited.append(own[i][:len(own[i]) - part] + own[i + 1][:part])
            more = winnower.of(edited)
            alike = [(likeness(hashes[bounds[i]:bounds[i + 1]], more[1][more[0][j]:more[0][j + 1]]),
                      likeness(hashes[bounds[i]:bounds[i + 1]], hashes[bounds[i + 1]:bounds[i + 2]]))
                     for j, i in enumerate(mine)]
            kept = _print_array(bounds, hashes, positions).take(pa.array(mine, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in mine], id_type), pa.array([len(own[i]) for i in mine], pa.int64()),
                 pa.array(edited, pa.string()), kept.cast(_PRINT_TYPE), _print_array(*more).cast(_PRINT_TYPE),
                 pa.array([a for a, _ in alike], pa.float64()), pa.array([b for _, b in alike], pa.float64())], names)

        id_type = None

        def rows():
            nonlocal id_type
            for batch in batches:
                id_type = batch.column("_id").type
                yield from zip(batch.column("_id").to_pylist(), batch.column("_range").to_pylist(),
                               batch.column("_guest").to_pylist(), texts(batch, "_text"))

        last = []
        for block in _blocks(rows(), lambda r: len(r[3]), block_chars):
            block = last + block
            last = block[-1:]
            yield compared(block)

    return map_batches(dealt.select("_id", "_text", "_range", "_guest"), run, schema).withColumnRenamed("_id", id_col)
