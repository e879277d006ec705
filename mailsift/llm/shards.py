"""Shards of near equal bytes that keep equal texts together: minimax contiguous partition.

Groups (equal texts) are ordered by the hash of their text. The smallest capacity is searched for
with which a greedy walk over the ordered group sizes needs no more shards than allowed. That walk
fills its first shards and leaves the rest to the last one, so of all cuts that keep this capacity
those with the largest smallest shard are taken, as far as the known sums tell groups apart. Everything on the data is native: a histogram of bytes by the hash's first
16 bits (65,536 rows at most) gives an upper and a lower bound for every cut, and only the buckets
between the two are refined by 8 more bits, until the bounds meet at single groups. So the driver
sees a bounded number of sums whatever the number of texts, and the capacity is that of the walk over
all groups. Two texts with one 64-bit hash would merely be kept together.

The shard is then a comparison with at most ``n_shards`` - 1 literals. Slots are numbered inside
(shard, bucket of the id's hash) and moved by the bucket's offset, so a text that fills a third of
the corpus does not meet in one task.

Null text: no bytes, size 1, in the group of the empty text. Repeated rows each get a slot. An empty
table gives an empty result; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIRST_BITS, STEP_BITS = 16, 8
SLOT_BUCKETS = 4096


class Atom(NamedTuple):
    """A run of groups: hashes from ``low`` to ``high``, under one hash prefix."""
    low: int
    high: int
    weight: int
    bits: int
    prefix: int

    @property
    def single(self) -> bool:
        return self.low == self.high


class Walk:
    """Greedy walks over ordered atoms. A walk that takes *whole* atoms is never ahead of the walk
    over all groups, one that treats atoms of several groups as *fluid* never behind it."""

    def __init__(self, atoms: list[Atom]):
        self.atoms = atoms
        self.sums = [0, *accumulate(a.weight for a in atoms)]

    def step(self, at: int, capacity: int, fluid: bool) -> int:
        """Where the shard that starts at running sum ``at`` ends."""
        end = min(at + capacity, self.sums[-1])
        i = bisect_right(self.sums, end) - 1
        return end if fluid and i < len(self.atoms) and not self.atoms[i].single else max(at, self.sums[i])

    def cuts(self, capacity: int, n_shards: int, fluid: bool) -> list[int]:
        out = [0]
        for _ in range(n_shards):
            out.append(self.step(out[-1], capacity, fluid))
        return out

    def smallest(self, n_shards: int, fluid: bool) -> int:
        """The least capacity with which ``n_shards`` shards hold everything, by binary search."""
        low, high = 0, self.sums[-1]
        while low < high:
            mid = (low + high) // 2
            fits = self.cuts(mid, n_shards, fluid)[-1] == self.sums[-1]
            low, high = (low, mid) if fits else (mid + 1, high)
        return low

    def vague(self, n_shards: int) -> list[Atom]:
        """Atoms of several groups inside which a cut of the best walk over groups may lie."""
        first = self.cuts(self.smallest(n_shards, True), n_shards, False)
        last = self.cuts(self.smallest(n_shards, False), n_shards, True)
        out = set()
        for low, high in zip(first[1:-1], last[1:-1]):
            i = bisect_right(self.sums, low) - 1
            while i < len(self.atoms) and self.sums[i] < high:
                out.add(i)
                i += 1
        return [self.atoms[i] for i in sorted(out) if not self.atoms[i].single]

    def evenest(self, n_shards: int) -> list[int]:
        """Cuts of the smallest capacity, with the largest smallest shard among those."""
        capacity, ends = self.smallest(n_shards, False), np.array(self.sums, np.int64)
        first = np.searchsorted(ends, ends - capacity, "left")      # where a shard that ends here may start

        def reached(least: int) -> list[np.ndarray]:
            """By number of shards, the ends that shards of ``least`` to ``capacity`` can have."""
            last = np.maximum(np.searchsorted(ends, ends - least, "right"), first)
            out = [ends == 0]
            for _ in range(n_shards):
                count = np.concatenate(([0], np.cumsum(out[-1])))
                out.append(count[last] > count[first])
            return out

        low, high = 0, self.sums[-1] // n_shards
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if reached(mid)[-1][-1] else (low, mid - 1)
        steps, cuts = reached(low), [len(ends) - 1]
        for k in range(n_shards - 1, -1, -1):
            at = cuts[-1]
            own = np.flatnonzero(steps[k] & (ends >= ends[at] - capacity) & (ends <= ends[at] - low))
            cuts.append(int(own[np.abs(ends[own] - self.sums[-1] * k // n_shards).argmin()]))
        return [self.sums[k] for k in reversed(cuts)]

    def starts(self, n_shards: int) -> list[int]:
        """First hashes of the second and later shards."""
        return [self.atoms[bisect_right(self.sums, c) - 1].low for c in self.evenest(n_shards)[1:-1] if c < self.sums[-1]]


def plan_cuts(sizes: DataFrame, n_shards: int, hash_col: str, size_col: str) -> list[int]:
    """First hashes of the second and later shards."""
    def sums(rows: DataFrame, bits: int) -> list[Atom]:
        prefix = F.shiftright(hash_col, 64 - bits) if bits < 64 else F.col(hash_col)
        found = rows.groupBy(prefix.alias("p")).agg(F.sum(size_col).alias("w"), F.min(hash_col).alias("lo"),
                                                    F.max(hash_col).alias("hi")).collect()
        return [Atom(r["lo"], r["hi"], r["w"], bits, r["p"]) for r in found]

    atoms = sorted(sums(sizes, FIRST_BITS))
    if not atoms:
        return []
    while vague := (walk := Walk(atoms)).vague(n_shards):
        fresh = []
        for bits in sorted({a.bits for a in vague}):
            own = [a.prefix for a in vague if a.bits == bits]
            rows = sizes.where(F.shiftright(hash_col, 64 - bits).isin(own))
            fresh += sums(rows, min(64, bits + STEP_BITS))
        out = {a.low for a in vague}
        atoms = sorted([a for a in atoms if a.low not in out] + fresh)
    return walk.starts(n_shards)


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)``, one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                               F.crc32(text.cast("binary")).alias("text_crc32"),
                               F.xxhash64(text).alias("_hash")), "shard-sizes")
    cuts = plan_cuts(rows, n_shards, "_hash", "size")
    shard = sum([(F.col("_hash") >= c).cast("int") for c in cuts], F.lit(0))
    rows = rows.withColumn("shard", shard).withColumn(
        "_bucket", F.pmod(F.xxhash64(id_col, "_hash"), F.lit(SLOT_BUCKETS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select(
        "shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(id_col, "_hash")
    return rows.withColumn("_row", F.row_number().over(inside)) \
        .join(F.broadcast(offsets), ["shard", "_bucket"]) \
        .select(id_col, "size", "text_crc32", "shard", (F.col("_offset") + F.col("_row") - 1).alias("slot"))
