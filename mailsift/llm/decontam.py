"""Benchmark passages in documents, by edit distance.

Texts are sequences of words (A-Z lowered, without ASCII punctuation), and the distance is the number of
word insertions, deletions and substitutions. A document leaks an item when a part of it is within
``max_edits`` (a fifth) of the item's words.

The CGK random walk embeds a sequence into a longer one in which edits become substitutions: at
step j it writes the word it stands on and moves on if bit j of that word's hash is set. Two
sequences that differ by few edits soon walk in step again, so most coordinates agree. Bit sampling
takes some coordinates of a walk, one from each of equal parts; repeated walks make the chance that
some anchor of a leaked item collides as high as wanted. Windows start at every word of a document,
and anchors at every word of an item, so an edit in one place leaves the other anchors untouched.

Walks are shorter for shorter items (``WALKS``), so that they stay inside the item. How many are
taken follows from ``recall``: ``repetitions_for`` measures, for each length among the items, how many
walks find that share of items with all allowed edits inside other text, and a kind of walk is
repeated as often as its worst length needs. At 0.95 the walks alone find 0.9 or more at every length
from 8 words on (two or three walks of 8 steps, one or two of 12, two of 20).

What the walks leave is found by equal runs of words: an item that may have ``e`` edits is cut into
``e + 1`` pieces, and an edit changes at most one of them, so some piece stands in the document as it
is. Every run of a piece's length in a document is looked up, so no leak is left to chance.
``by_walk`` tells which leaks the walks found. Items too short for an edit are one piece.

All windows of a batch are embedded together: the walk from position p at step j is the walk from p
or p + 1 at step j + 1, so a walk of n steps for all positions is n passes over the word array from the last step to the first. A collision names an item and an alignment; the
item-sized window there, joined with those it overlaps, is verified by exact edit distance (free
ends in the document).

Documents are only read: no shuffle. Items are sent to the tasks in blocks of at most
``BLOCK_BYTES`` of text; a larger benchmark takes more passes over the documents.

Null or empty texts leak nothing. Items without a word, empty or null name no leak. Repeated items each
give a row. Repeated documents are judged one by one. Ids are of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, map_batches, mix, seeds, window_hashes


class Walk(NamedTuple):
    steps: int
    samples: int


#: Kinds of walk by the least words of an item; each step moves on by half a word on average.
WALKS = ((25, Walk(20, 5)), (14, Walk(12, 4)), (0, Walk(8, 4)))
LONGEST_WALK = 20
RECALL = 0.95
#: Walks of a kind, at most, and trials per length, when their number is measured.
MOST_WALKS, TRIALS = 12, 300
MAX_EDITS = 0.2
#: Words of a piece that are compared, at most (the verification reads all).
PIECE_WORDS = 8
BLOCK_BYTES = 32 << 20
CHUNK = 1 << 15
_TABLE_BITS = 22


class Item(NamedTuple):
    item_id: int
    words: np.ndarray


class Leak(NamedTuple):
    row: int
    item_id: int
    edits: int
    n_words: int
    start: int
    by_walk: bool


def walk_of(n: int) -> Walk:
    """The kind of walk for items of ``n`` words."""
    return next(walk for least, walk in WALKS if n >= least)


def anchors_of(n: int) -> int:
    """The words of an item where anchors start: not so near its end that most walks leave it."""
    return max(n - walk_of(n).steps // 4, 0)


def coordinates(walk: Walk, repetition: int) -> list[int]:
    """The sampled steps of a walk: one in each of equal parts."""
    rng = np.random.Generator(np.random.PCG64(900 + 100 * walk.steps + repetition))
    width = walk.steps // walk.samples
    return [int(k * width + rng.integers(width)) for k in range(walk.samples)]


def walk_keys(words: np.ndarray, walk: Walk, repetition: int) -> np.ndarray:
    """The sampled coordinates of the walks from every position, hashed to 32 bits. Word 0 (a gap,
    or what lies behind the last word) stops a walk."""
    n = len(words)
    factor = dict(zip(coordinates(walk, repetition), seeds(walk.samples, 800 + repetition, odd=True).astype(np.uint32)))
    with np.errstate(over="ignore"):
        x = np.zeros(n + walk.steps + 1, np.uint32)
        x[:n] = (mix(words ^ seeds(1, 700 + repetition)[0]) >> np.uint64(32)) * (words != 0)
        key = np.zeros(len(x), np.uint32)
        for j in range(max(factor), -1, -1):
            moves = np.negative((x[:-1] >> np.uint32(j)) & np.uint32(1))     # all bits set, or none
            key[:-1] ^= (key[1:] ^ key[:-1]) & moves                         # next position, or this
            if j in factor:
                key += x * factor[j]
    return key[:n]


def allowed_edits(n: int, max_edits: float) -> int:
    return int(max_edits * n)


def _embedded_trials(n: int, edits: int, trials: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of random items, and rows with the same items under ``edits`` random edits inside other text;
    zeros fill both."""
    rng = np.random.default_rng(1000 * n + edits)
    around = LONGEST_WALK
    items = rng.integers(1, 2**63, (trials, n), dtype=np.uint64)
    texts_ = np.zeros((trials, n + edits + 2 * around), np.uint64)
    for t in range(trials):
        part = items[t].tolist()
        for _ in range(edits):
            at, new = int(rng.integers(len(part))), int(rng.integers(1, 2**63))
            part[at:at + 1] = ([], [new], [part[at], new])[int(rng.integers(3))]
        row = [*rng.integers(1, 2**63, around).tolist(), *part, *rng.integers(1, 2**63, around).tolist()]
        texts_[t, :len(row)] = row
    return items, texts_


@lru_cache(maxsize=4096)
def repetitions_for(recall: float, n: int, edits: int, trials: int = TRIALS, most: int = MOST_WALKS) -> int:
    """The fewest walks with which ``recall`` of the items of ``n`` words collide at some anchor when they
    stand in a document with ``edits`` random edits (``most`` if they do not suffice)."""
    walk, anchors = walk_of(n), anchors_of(n)
    items, others = (np.pad(x, ((0, 0), (0, LONGEST_WALK + 1))) for x in _embedded_trials(n, edits, trials))
    hit = np.zeros(trials, bool)
    place = np.arange(trials, dtype=np.uint64)[:, None] << np.uint64(32)
    for r in range(most):
        own = walk_keys(items.ravel(), walk, r).reshape(items.shape)[:, :anchors]
        seen = (walk_keys(others.ravel(), walk, r).reshape(others.shape) | place)[others != 0]
        hit |= np.isin(own | place, seen).any(axis=1)
        if hit.mean() >= recall:
            return r + 1
    return most


def plan_walks(lengths: list[int], max_edits: float, recall: float) -> dict[Walk, int]:
    """How often each kind of walk is repeated, for items of these lengths; longer ones than 64 words
    are measured at 64, where the recall is higher already. No walk for items that may have no edit."""
    plan: dict[Walk, int] = {}
    for n in {min(n, 64) for n in lengths if allowed_edits(n, max_edits)}:
        plan[walk_of(n)] = max(plan.get(walk_of(n), 0), repetitions_for(recall, n, allowed_edits(n, max_edits)))
    return plan


def run_keys(words: np.ndarray, width: int) -> np.ndarray:
    """The runs of ``width`` words, hashed to 32 bits."""
    return (window_hashes(words, width) >> np.uint64(32)).astype(np.uint32)


class Index:
    """The anchors of a block of items, by walk, and their pieces, by width: sorted keys with item and
    offset, and a table of one byte per key prefix that answers most look-ups."""

    def __init__(self, items: list[Item], plan: dict[Walk, int], max_edits: float, pieces: bool = True):
        self.items = items
        self.lengths = np.array([len(i.words) for i in items], np.int64)
        self.allowed = np.array([allowed_edits(n, max_edits) for n in self.lengths.tolist()], np.int64)
        self.known = [np.unique(i.words) for i in items]
        self.tables = []
        for walk, repetitions in plan.items():
            own = [k for k, n in enumerate(self.lengths.tolist()) if self.allowed[k] and walk_of(n) == walk]
            if not own:
                continue
            anchors = [anchors_of(int(self.lengths[k])) for k in own]
            for r in range(repetitions):
                keys = [walk_keys(items[k].words, walk, r)[:n] for k, n in zip(own, anchors)]
                self._add(lambda words, walk=walk, r=r: walk_keys(words, walk, r), walk.steps, np.concatenate(keys),
                          np.repeat(own, anchors), np.concatenate([np.arange(n) for n in anchors]), True)
        if not pieces:
            return
        widths = np.minimum(self.lengths // (self.allowed + 1), PIECE_WORDS)
        for width in np.unique(widths).tolist():
            keys, item, offset = [], [], []
            for k in np.flatnonzero(widths == width).tolist():
                n, parts = int(self.lengths[k]), int(self.allowed[k]) + 1
                at = np.arange(parts) * n // parts
                keys.append(run_keys(items[k].words, width)[at])
                item.append(np.full(parts, k)), offset.append(at)
            self._add(lambda words, width=width: run_keys(words, width), width - 1,
                      *map(np.concatenate, (keys, item, offset)), False)

    def _add(self, keys_of, beyond: int, keys: np.ndarray, item: np.ndarray, offset: np.ndarray, is_walk: bool) -> None:
        """A table; ``keys_of`` gives a document's keys and reads ``beyond`` more words."""
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        seen = np.zeros(1 << _TABLE_BITS, bool)
        seen[keys >> np.uint32(32 - _TABLE_BITS)] = True
        self.tables.append((keys_of, beyond, keys, item[order], offset[order], seen, is_walk))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(Item, position, offset in the item, whether of a walk) of all collisions in ``words``."""
        found = [(*(np.empty(0, np.int64),) * 3, np.empty(0, bool))]
        for keys_of, beyond, keys, item, offset, seen, is_walk in self.tables:
            for at in range(0, len(words), CHUNK):       # a chunk stays in the cache
                part = keys_of(words[at:at + CHUNK + beyond])[:CHUNK]
                near = np.flatnonzero(seen[part >> np.uint32(32 - _TABLE_BITS)])
                first = np.searchsorted(keys, part[near], "left")
                many = np.searchsorted(keys, part[near], "right") - first
                near, first, many = near[many > 0], first[many > 0], many[many > 0]
                each = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found.append((item[each], at + np.repeat(near, many), offset[each], np.full(len(each), is_walk)))
        return tuple(np.concatenate(x) for x in zip(*found))


def _edits(item: np.ndarray, part: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The last row of the edit distances, from the first: edits of the item up to each word of ``part``."""
    steps = np.arange(len(part) + 1)
    for w in item.tolist():
        best = np.minimum(row[1:] + 1, row[:-1] + (part != w))
        row = np.minimum.accumulate(np.concatenate(([row[0] + 1], best)) - steps) + steps
    return row


def nearest_run(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any run of words inside ``part``, and where a run with so
    few begins (of those with one end, the one nearest to the item's length)."""
    ends = _edits(item, part, np.zeros(len(part) + 1, np.int64))       # a run may begin anywhere
    end, least = int(ends.argmin()), int(ends.min())
    lengths = np.flatnonzero(_edits(item[::-1], part[:end][::-1], np.arange(end + 1)) == least)
    return least, end - int(lengths[np.abs(lengths - len(item)).argmin()])


def _may_leak(known: np.ndarray, part: np.ndarray, n: int, allowed: int) -> bool:
    """Whether some ``n + allowed`` words of ``part`` hold enough words of the item."""
    own = known[np.minimum(np.searchsorted(known, part), len(known) - 1)] == part
    count = np.concatenate(([0], np.cumsum(own)))
    span = min(len(part), n + allowed)
    return bool((count[span:] - count[:len(count) - span]).max() >= n - allowed)


def leaks_in(index: Index, rows: list[np.ndarray]) -> Iterator[Leak]:
    """For each (row, item) that leaks, the run with the fewest edits."""
    if not rows:
        return
    lengths = [len(r) for r in rows]
    # documents are kept apart by more zero words than a walk can cross
    gap = np.zeros(LONGEST_WALK + 1, np.uint64)
    words = np.concatenate([x for r in rows for x in (r, gap)])
    begin = np.cumsum([0] + [n + len(gap) for n in lengths])
    item, at, offset, walked = index.hits(words)
    row = np.searchsorted(begin, at, "right") - 1
    start = at - offset - begin[row]                     # the item may begin before the document
    order = np.lexsort((start, item, row))
    row, item, start, walked = row[order], item[order], start[order], walked[order]
    reach = index.lengths[item] + 2 * index.allowed[item]
    new = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > reach[1:])
    first, last = np.flatnonzero(np.r_[True, new][:len(row)]), np.flatnonzero(np.r_[new, True][:len(row)])
    any_walk = np.logical_or.reduceat(walked, first) if len(first) else walked
    best: dict[tuple[int, int], Leak] = {}
    for r, k, low, high, by_walk in zip(row[first].tolist(), item[first].tolist(), start[first].tolist(),
                                        start[last].tolist(), any_walk.tolist()):
        old = best.get((r, k))
        if old is not None and not old.edits:
            continue
        n, allowed = int(index.lengths[k]), int(index.allowed[k])
        low = max(0, low - allowed)
        part = rows[r][low:max(0, high + n + allowed)]
        if len(part) < n - allowed or not _may_leak(index.known[k], part, n, allowed):
            continue
        edits, place = nearest_run(index.items[k].words, part)
        if edits <= allowed and (old is None or edits < old.edits):
            best[r, k] = Leak(r, index.items[k].item_id, edits, n, low + place, by_walk)
    yield from (best[key] for key in sorted(best))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[Item]]:
    """The items in blocks of at most ``BLOCK_BYTES`` of text, read one partition at a time."""
    words, block, size = Words(lower=True, letters=True), [], 0
    for r in benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col).toLocalIterator():
        sequence = words.of(pa.array([r[1]]))[0]
        if not len(sequence):
            continue
        if block and size + len(r[1]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(Item(r[0], sequence))
        size += len(r[1])
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", max_edits: float = MAX_EDITS,
               recall: float = RECALL) -> DataFrame:
    """``(id, item_id, edits, n_words, start_word, by_walk)``: each item that a row of ``docs`` leaks.
    ``recall`` is what the walks alone reach."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind, item_type = benchmark.schema[item_col].dataType.simpleString(), to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"_id {kind}, item_id {item_kind}, edits int, n_words int, start_word bigint, by_walk boolean"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        sent = sc.broadcast(block)
        plan = plan_walks([len(i.words) for i in block], max_edits, recall)

        def run(batches, sent=sent, plan=plan):
            index, words = Index(sent.value, plan, max_edits), Words(lower=True, letters=True)
            for batch in batches:
                found = list(leaks_in(index, words.rows(batch.column("_text"))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array([f.row for f in found], pa.int64())),
                     pa.array([f.item_id for f in found], item_type), pa.array([f.edits for f in found], pa.int32()),
                     pa.array([f.n_words for f in found], pa.int32()), pa.array([f.start for f in found], pa.int64()),
                     pa.array([f.by_walk for f in found], pa.bool_())],
                    ["_id", "item_id", "edits", "n_words", "start_word", "by_walk"])

        part = map_batches(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("_id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", max_edits: float = MAX_EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    sc = docs.sparkSession.sparkContext
    text_at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text_col):
        sent = sc.broadcast(block)
        plan = plan_walks([len(i.words) for i in block], max_edits, recall)

        def run(batches, sent=sent, plan=plan):
            index, words = Index(sent.value, plan, max_edits), Words(lower=True, letters=True)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                rows = words.rows(batch.column(text_at))
                keep[[f.row for f in leaks_in(index, rows)]] = False
                yield batch.filter(pa.array(keep))

        docs = map_batches(docs, run, docs.schema)
    return docs
