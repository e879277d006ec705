"""Periodic runs of words, by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at
least ``max(24, 3 q)`` words long, that no neighbouring word extends.

Words are numbered within a batch of documents, each document with numbers of its own, so the batch
is one sequence and no run crosses documents. At scale L = 8, 16, 32, ... the sequence is cut into
blocks of L words. A run with a period q in [L, 2L) covers, within its first L words, the start of a
block that lies in the run together with its copy q words on (at L = 8 for all q below 16). For each
block, sum_j (x[b + j] - x[b + d + j])^2 over all distances d of that scale is two prefix sums of
squares less twice a correlation, which a number-theoretic transform over a prime field gives
exactly; it is 0 for every occurrence of the block in the window behind it. Each such distance seeds
a comparison word by word to both sides, which yields the maximal stretch with that period and
confirms it; a stretch found before has a smaller period.

Blocks that can hold no seed are not transformed: those with a word that does not come again within
2L words, and those that lie with their window inside a run found at a smaller scale (there, every
distance is a multiple of that run's period). A run of n words costs one comparison, and the
transforms n log n per scale.

Documents are only read: nothing is shuffled. Null or empty texts have no words and no runs. Every
input row gives one row, also with a null or repeated id; other columns are not read. Batches are
cut by their number of words; a longer text is one batch of its own, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

MIN_WORDS = 24
MIN_EXPONENT = 3
#: Words of the smallest block; with it a run of 24 words holds a block and its copy.
SMALLEST = 8
#: A prime with roots of unity of order 2^30, and a generator of its units.
PRIME, ROOT = 3 * 2**30 + 1, 5
BATCH_WORDS = 1 << 18
#: Cells of the blocks transformed together.
CELLS = 1 << 20

_P = np.uint64(PRIME)
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_twiddles: dict[tuple[int, bool], np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


def _roots(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 ``half``."""
    key = (half, inverse)
    if key not in _twiddles:
        root = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        out = np.ones(half, np.uint64)
        done, step = 1, root
        while done < half:                      # the table doubles: w^(i + done) = w^i * w^done
            out[done:2 * done] = _mod(out[:done] * np.uint64(step))
            done, step = 2 * done, step * step % PRIME
        _twiddles[key] = out
    return _twiddles[key]


def transform(a: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order."""
    rows, n = a.shape
    half = n // 2
    while half:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        a = np.stack((_mod(low + high), _mod(_mod(low + (_P - high)) * _roots(half, False))), axis=2).reshape(rows, n)
        half //= 2
    return a


def inverse(a: np.ndarray) -> np.ndarray:
    """Rows back from bit-reversed transforms."""
    rows, n = a.shape
    half = 1
    while half < n:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], _mod(v[:, :, 1] * _roots(half, True))
        a = np.stack((_mod(low + high), _mod(low + (_P - high))), axis=2).reshape(rows, n)
        half *= 2
    return _mod(a * np.uint64(pow(n, -1, PRIME)))


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For rows of L words and of 2L words: the sums of squared differences, in the field, between the
    block and the window from each of its first L words on."""
    rows, size = blocks.shape
    reversed_ = np.zeros((rows, 2 * size), np.uint64)
    reversed_[:, :size] = blocks[:, ::-1]
    products = inverse(_mod(transform(reversed_) * transform(windows)))[:, size - 1:2 * size - 1]
    squares = np.zeros((rows, 2 * size + 1), np.uint64)
    np.cumsum(_mod(windows * windows), axis=1, out=squares[:, 1:])
    own = _mod(_mod(blocks * blocks).sum(axis=1, dtype=np.uint64))[:, None]
    beside = _mod(squares[:, size:2 * size] - squares[:, :size])
    return _mod(own + beside + np.uint64(2) * (_P - products))


def _next_same(x: np.ndarray) -> np.ndarray:
    """For each place the distance to the next equal word (none: more than the length)."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), len(x) + 1, np.int64)
    same = x[order[1:]] == x[order[:-1]]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


def _stretch(x: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The first place and the end of the maximal stretch with period ``d`` that holds words ``at`` and ``at + d``."""
    def reach(a: np.ndarray, b: np.ndarray) -> int:
        """Equal leading words of two arrays, read in growing steps."""
        done, step = 0, 64
        while done < len(a):
            differ = np.flatnonzero(a[done:done + step] != b[done:done + step])
            if len(differ):
                return done + int(differ[0])
            done, step = done + step, 2 * step
        return len(a)

    n = len(x) - d
    right = reach(x[at:n], x[at + d:])
    left = reach(x[:at][::-1], x[d:at + d][::-1])
    return at - left, at + right + d


def find(x: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs of a sequence of numbers as (start, length, period), by start, then period. ``longest``
    bounds the length of a run, if known."""
    n = len(x)
    longest = n if longest is None else longest
    found: dict[tuple[int, int], int] = {}
    again = _next_same(x)
    values = x.astype(np.uint64) + np.uint64(1)
    size = SMALLEST
    while MIN_EXPONENT * size <= longest or (size == SMALLEST and longest >= MIN_WORDS):
        count = n // size
        begin = np.arange(count) * size
        far = again[:count * size].reshape(count, size).max(axis=1)
        wanted = far < 2 * size
        inside = np.zeros(n + 1, np.int64)
        for start, end in found:                # blocks that lie there with all their window
            if end - start > 3 * size:
                inside[start] += 1
                inside[end - 3 * size] -= 1
        wanted &= np.cumsum(inside)[begin] == 0
        begin = begin[wanted]
        padded = np.concatenate((values, np.zeros(3 * size, np.uint64)))
        seeds = []
        for offset in ((0, size) if size == SMALLEST else (size,)):
            for a in range(0, len(begin), max(1, CELLS // (2 * size))):
                at = begin[a:a + max(1, CELLS // (2 * size))]
                blocks = padded[at[:, None] + np.arange(size)]
                windows = padded[(at + offset)[:, None] + np.arange(2 * size)]
                row, d = np.nonzero(mismatches(blocks, windows) == 0)
                seeds.append((d + offset, at[row]))
        if seeds:
            distance, at = (np.concatenate(s) for s in zip(*seeds))
            order = np.lexsort((at, distance))
            last = (0, 0)                       # distance and end of the latest stretch
            for d, b in zip(distance[order].tolist(), at[order].tolist()):
                if not d or (d == last[0] and b + d < last[1]):
                    continue
                start, end = _stretch(x, b, d)
                last = (d, end)
                if end - start >= max(MIN_WORDS, MIN_EXPONENT * d) and (start, end) not in found:
                    found[start, end] = d
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def runs_of(rows: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each document of a batch."""
    numbers = []
    first = 0
    for words in rows:
        table = {w: first + k for k, w in enumerate(dict.fromkeys(words))}
        numbers.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
        first += len(table)
    begin = np.cumsum([0] + [len(x) for x in numbers])
    longest = max((len(x) for x in numbers), default=0)
    out: list[list] = [[] for _ in rows]
    if longest >= MIN_WORDS:
        for start, length, period in find(np.concatenate(numbers), longest):
            row = int(np.searchsorted(begin, start, "right")) - 1
            out[row].append((start - int(begin[row]), length, period))
    yield from out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, of each run only the first period."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              batch_words: int = BATCH_WORDS) -> DataFrame:
    """``(id, n_words, runs array<struct<start, length, period>>, collapsed)``, one row per row of
    ``docs``: the runs by start, then period, and the text without the repetitions."""

    def run(batches):
        for batch in batches:
            rows = [words_of(t) for t in texts(batch, "_text")]
            at = 0
            while at < len(rows):
                end, size = at, 0
                while end < len(rows) and (end == at or size + len(rows[end]) <= batch_words):
                    size += len(rows[end])
                    end += 1
                part = rows[at:end]
                found = list(runs_of(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(at, end - at), pa.array([len(w) for w in part], pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], _RUN_TYPE),
                     pa.array([collapsed(w, f) for w, f in zip(part, found)], pa.binary()).cast(pa.string())],
                    ["_id", "n_words", "runs", "collapsed"])
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                      f"_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
    return out.withColumnRenamed("_id", id_col)
