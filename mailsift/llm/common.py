"""Helpers shared by the operators of this package.

Words are runs of characters other than the six ASCII blanks ``\\x20 \\x09-\\x0D``, which is
exactly what ``bytes.split()`` cuts at, and ASCII lower-casing is ``bytes.lower()``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import materialize, scratch_path, ship_package
from ..sources.tables import read_table

#: Distinct words a task keeps in memory before it starts its table anew.
WORD_TABLE_LIMIT = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, lineage cut."""
    return materialize(df, f"llm-{name}")


def written_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``written``, as a table bucketed by ``key`` into ``spark.sql.shuffle.partitions`` buckets,
    so that a join or grouping by the key reads it where it is. The name leaves the catalog at once,
    the files stay with the other tables of the run."""
    spark = df.sparkSession
    alias = f"llm_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch_path(spark, f"llm-{name}")) \
        .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(alias)
    out = spark.table(alias)
    spark.sql(f"DROP TABLE {alias}")
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
                schema) -> DataFrame:
    """``mapInArrow`` with this package importable in the Python workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The batch's texts; null counts as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) over a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int, odd: bool = False) -> np.ndarray:
    """``n`` fixed 64-bit constants for ``seed``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = rng.integers(0, 2**64, size=n, dtype=np.uint64)
    return out | np.uint64(1) if odd else out


_BYTE = np.arange(256, dtype=np.uint8)
_BLANK = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_ALNUM = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 48) & (_BYTE <= 57)) | (_BYTE >= 128)
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE)
#: Bytes hashed at once: temporary arrays stay small whatever the batch.
_PIECE_BYTES = 1 << 20


class Words:
    """Words of Arrow text columns as 64-bit ids, a hash of each word's bytes by position.

    ``lower`` folds A-Z. ``letters`` also drops ASCII punctuation, and words that are nothing else.
    An id is never 0 and depends on the word alone, so ids agree between tasks.
    """

    def __init__(self, lower: bool = False, letters: bool = False):
        self.lut = seeds(256, 21)[_LOWER if lower else _BYTE]
        self.drop = ~_ALNUM & ~_BLANK if letters else None
        self.weights = np.empty(0, np.uint64)

    def _weights(self, n: int) -> np.ndarray:
        if len(self.weights) < n:
            self.weights = mix(np.arange(1, 2 * n + 1, dtype=np.uint64)) | np.uint64(1)
        return self.weights

    def _piece(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in ``data`` and the byte each one starts at; texts begin at ``begin``."""
        inside = ~_BLANK[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begin = begin[begin < len(data)]
        first[begin] = inside[begin]
        at = np.flatnonzero(first)
        if self.drop is not None:
            word = np.cumsum(first, dtype=np.int32)
            inside &= ~self.drop[data]
            word = word[inside]
            chars = data[inside]
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
            at = at[word[start] - 1]
        else:
            chars = data[inside]
            start = (np.cumsum(inside, dtype=np.int64) - 1)[at]
        if not len(start):
            return np.empty(0, np.uint64), at
        lengths = np.diff(np.r_[start, len(chars)])
        place = np.arange(len(chars)) - np.repeat(start, lengths)
        with np.errstate(over="ignore"):
            ids = mix(np.add.reduceat(self.lut[chars] * self._weights(int(lengths.max()))[place], start))
        ids[ids == 0] = 1
        return ids, at

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column in order, and where each row's begin (one more than rows)."""
        n = len(column)
        wide = pa.types.is_large_string(column.type)
        _, where, data = column.buffers()
        if not n or data is None:
            return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
        offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1]
        offsets = offsets.astype(np.int64)
        if column.null_count:                   # a null has no bytes, whatever its slot covers
            return self.of(pa.array([t or "" for t in column.to_pylist()], pa.string()))
        data = np.frombuffer(data, np.uint8)
        ids, bounds, total, i = [], [np.zeros(1, np.int64)], 0, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE_BYTES, "right")) - 1)
            begin = offsets[i:j + 1] - offsets[i]
            found, at = self._piece(data[offsets[i]:offsets[j]], begin[:-1])
            bounds.append(total + np.searchsorted(at, begin[1:]))
            ids.append(found)
            total += len(found)
            i = j
        return np.concatenate(ids), np.concatenate(bounds)

    def rows(self, column: pa.Array) -> list[np.ndarray]:
        ids, bounds = self.of(column)
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive word ids (fewer words: none)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k, c in enumerate(seeds(width, 11 + width, odd=True)):
            out += ids[k:k + n] * c
    return mix(out)
