"""Repeated lines, found with two Bloom filters.

A line's key is the line without ASCII blanks at its ends and with A-Z lowered. Keys of
``min_chars`` code points or more that occur in ``min_docs`` documents or more lose all their
lines, except in the largest id that holds them.

1. Each task sets the bits of its documents' keys in a *once* filter and, for bits that are set
   already by another document, in a *twice* filter. Filters are cut into slices; a task sends its
   non-empty slices, deflated, and slices merge one at a time: the sum saturates at two, so the
   order of merging does not matter.
2. A key all of whose bits are in the merged twice filter may repeat; every other key surely occurs
   in one document only. Only these suspects are shuffled, as 128-bit digests with their ids.
3. Their exact counts and largest ids are aggregated (partially before the shuffle, so that one
   line in a third of all documents is a few rows). The verdicts meet the documents by key and salt,
   so such a line does not meet in one task, and the lines to drop go back by id.

The filter size is a parameter, not a function of the input: 2^27 bits are 16 MB in the broadcast.
A filter that fills up at a larger corpus lets more keys through to step 2 and 3 and changes no
result.

Null text: one empty line, stays null. Null ids: such rows lose the repeated lines and never hold
the line that stays; they do not count towards ``min_docs``. Repeated ids count once, and their rows
lose the same lines. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, texts, unused, written

MIN_CHARS = 20
MIN_DOCS = 3
FILTER_BITS = 1 << 27
SLICE_BITS = 1 << 17
PROBES = 2
#: Tasks over which the documents of one repeated line are dealt when its verdict goes back.
SALTS = 16


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _long(key: bytes, min_chars: int) -> bool:
    """Whether the key has at least ``min_chars`` code points."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _keys(text: str, min_chars: int) -> set[bytes]:
    return {k for line in text.encode("utf-8", "surrogatepass").split(b"\n") if _long(k := line_key(line), min_chars)}


def _probes(keys, bits: int) -> np.ndarray:
    """Bit positions of each key: key x probe."""
    h = np.fromiter((xxhash.xxh3_128_intdigest(k) & (2**64 - 1) for k in keys), np.uint64)
    mask = np.uint64(bits - 1)
    return np.stack([(h >> np.uint64(32 * p)) & mask for p in range(PROBES)], axis=1).astype(np.int64)


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).astype(bool)


def twice_filter(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS,
                 bits: int = FILTER_BITS) -> dict[int, bytes]:
    """The merged twice filter, by slice; at most ``bits`` / 8 bytes."""
    width = min(SLICE_BITS, bits)

    def build(batches):
        count = np.zeros(bits, np.uint8)        # 0, 1, or 2 and more documents of this task
        for batch in batches:
            for t in texts(batch, "_text"):
                keys = _keys(t, min_chars)
                if keys:
                    at = np.unique(_probes(keys, bits))
                    count[at] += count[at] < 2
        level = count.reshape(-1, width)
        used = np.flatnonzero(level.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([_pack(level[k] > 0) for k in used], pa.binary()),
                 pa.array([_pack(level[k] > 1) for k in used], pa.binary())], ["slice", "once", "twice"])

    def merge(batches):
        at, once, twice = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_pack(twice)], pa.binary())],
                                              ["slice", "twice"])
        for batch in batches:                   # rows come sorted by slice
            for k, o, t in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "twice"))):
                if k != at:
                    if at is not None and twice.any():
                        yield out()
                    at, once, twice = k, np.zeros(width, bool), np.zeros(width, bool)
                o, t = _unpack(o), _unpack(t)
                twice |= t | (once & o)
                once |= o
        if at is not None and twice.any():
            yield out()

    parts = map_batches(docs.select(F.col(text_col).alias("_text")), build, "slice int, once binary, twice binary")
    merged = map_batches(parts.repartition("slice").sortWithinPartitions("slice"), merge, "slice int, twice binary")
    return {r["slice"]: bytes(r["twice"]) for r in merged.collect()}


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
             bits: int = FILTER_BITS) -> DataFrame:
    """``(id, key)``: per document its distinct keys that may occur in another one."""
    slices = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, text_col, min_chars, bits))
    width = min(SLICE_BITS, bits)

    def run(batches):
        twice = np.zeros(bits, bool)
        for k, data in slices.value.items():
            twice[k * width:(k + 1) * width] = _unpack(data)
        for batch in batches:
            rows, keys = [], []
            for i, t in enumerate(texts(batch, "_text")):
                own = list(_keys(t, min_chars))
                if own:
                    found = [own[k] for k in np.flatnonzero(twice[_probes(own, bits)].all(axis=1))]
                    rows += [i] * len(found)
                    keys += [xxhash.xxh3_128_digest(k) for k in found]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows, pa.int64())),
                                              pa.array(keys, pa.binary())], ["id", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                       f"id {kind}, key binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, bits: int = FILTER_BITS, counts: bool = True) -> DataFrame:
    """``docs`` with the repeated lines cut from ``text_col``; with ``counts`` also ``n_lines``
    (before) and ``n_dropped``, and an error if ``docs`` has a column of such a name."""
    if counts and {"n_lines", "n_dropped"} & {c.lower() for c in docs.columns}:
        raise ValueError("n_lines or n_dropped is a column already")
    of, dropped = unused(docs, "_llm_id", "_llm_drop")
    found = written(suspects(docs, id_col, text_col, min_chars, bits), "suspects")      # counted, then judged
    confirmed = found.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")) \
        .where(F.col("n") >= min_docs)
    salted = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    drops = found.join(salted, ["key", "salt"]).where(~F.col("id").eqNullSafe(F.col("keeper"))) \
        .groupBy(F.col("id").alias(of)).agg(F.collect_set("key").alias(dropped))
    joined = docs.join(drops, F.col(id_col).eqNullSafe(F.col(of)), "left").drop(of)
    width, at = len(docs.columns), docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for t, drop in zip(batch.column(at).to_pylist(), batch.column(dropped).to_pylist()):
                lines = (t or "").split("\n")
                n_lines.append(len(lines))
                if drop:
                    drop = set(drop)
                    stay = [x for x in lines
                            if not (_long(k := line_key(x.encode("utf-8", "surrogatepass")), min_chars)
                                    and xxhash.xxh3_128_digest(k) in drop)]
                    t = "\n".join(stay)
                    n_dropped.append(len(lines) - len(stay))
                else:
                    n_dropped.append(0)
                kept.append(t)
            columns = [pa.array(kept, pa.string()) if k == at else batch.column(k) for k in range(width)]
            more = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays(columns + more, [f.name for f in schema.fields])

    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if counts else []
    schema = T.StructType(list(docs.schema.fields) + extra)
    return map_batches(joined, cut, schema)
