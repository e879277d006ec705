"""Near duplicates of documents with SetSketch registers.

A document is the set of its word shingles. ``REGISTERS`` independent hashes of a shingle are read
as exponential variables; a register keeps the set's minimum on an exponential scale,
``floor(1 - log_b(min))`` cut to 16 bits. Registers merge by maximum, and two documents agree in a
register about as often as they share shingles, so bands of ``BAND`` registers serve as keys.

1. Sketches are one narrow pass. Documents with equal word sequences are one class with a number of
   its own, so thousands of exact copies cost one row from here on, and no id is needed to be unique.
2. Bands: documents that share a bucket are partners, and their texts are fetched once. A bucket's
   documents are compared with its centre only, the one with the most company in all its buckets (the
   original of a group of copies rather than one of its variants). The links that hold are contracted
   to components, so a group of thousands of near copies is a star.
3. Buckets that still hold two components are finished by a prefix filter, which is exact: shingles
   are put in one order, the rarest first, and two sets above the threshold share one of their first
   ones, behind which enough shingles are left in both. Only pairs of different components are made,
   and no pair that the two positions rule out, so no group is expanded into pairs of itself.
4. A pair is dropped if the likelihood of its registers rules out the threshold: how many registers
   are greater, smaller and equal has a known distribution given both sizes and the similarity, which
   is maximised jointly; the pair stays unless the threshold is ``MARGIN`` log units less likely than
   the best similarity. The rest is verified on the full sets.

Components are found by alternating large and small stars on the links, in written tables. Nothing
but counts reaches the driver.

A text without words (or null) has an empty set, links with nothing, and is its own component. Fewer
words than a shingle make one shingle of them all. A null id cannot be linked or dropped: its
component is null and it is kept. Rows are linked by their words alone: a repeated id links nothing,
equal texts under different ids are one component. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import heavy_of_counts, split_join
from .common import Words, map_batches, mix, seeds, unused, window_hashes, written

REGISTERS = 96
BAND = 4
#: SetSketch: base of the scale, rate of the variables, largest register (two bytes).
BASE, RATE, LIMIT = 1.001, 20.0, 65535
MARGIN = 14.0
#: A bucket or shingle with fewer rows than this is never cut into pieces for a join.
HEAVY = 100


def shingle_set(ids: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of a word sequence as sorted 64-bit hashes."""
    if 0 < len(ids) < width:
        return window_hashes(ids, len(ids))
    return np.unique(window_hashes(ids, width))


class Sketcher:
    def __init__(self):
        self.factor = seeds(REGISTERS, 31, odd=True)
        self.shift = seeds(REGISTERS, 32)

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(REGISTERS, np.iinfo(np.uint64).max)
        with np.errstate(over="ignore"):
            for k in range(0, len(shingles), 512):          # a block of hashes stays in the cache
                block = shingles[k:k + 512, None] * self.factor + self.shift
                np.minimum(least, block.min(axis=0), out=least)
        uniform = (least.astype(np.float64) + 1) / 2.0**64
        value = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
        return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT).astype(np.uint16)

    @staticmethod
    def bands(registers: np.ndarray) -> np.ndarray:
        rows = registers.reshape(-1, BAND).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = (rows * seeds(BAND, 33, odd=True)).sum(axis=1) + np.arange(len(rows), dtype=np.uint64) * seeds(1, 34)
        return mix(key).view(np.int64)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """Of ``docs(_id, _text, _hash)``: ``(id, text_hash, n_shingles, words_key, registers, bands)`` per row."""

    def run(batches):
        words, sketcher = Words(lower=True), Sketcher()
        for batch in batches:
            n, key, registers, bands = [], [], [], []
            for ids in words.rows(batch.column("_text")):
                s = shingle_set(ids, width)
                n.append(len(s))
                if not len(s):
                    key.append(None), registers.append(None), bands.append(None)
                    continue
                order = np.arange(len(ids), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    key.append(b"".join(int(mix(ids * c + order).sum()).to_bytes(8, "big") for c in seeds(2, 35, odd=True)))
                r = sketcher.registers(s)
                registers.append(r.tobytes())
                bands.append(sketcher.bands(r))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "text_hash", "n_shingles", "words_key", "registers", "bands"])

    kind = docs.schema["_id"].dataType.simpleString()
    return map_batches(docs, run, f"id {kind}, text_hash bigint, n_shingles bigint, words_key binary, registers binary, "
                                  "bands array<bigint>")


def _log_likelihood(similarity, share_a, share_b, more, less, same):
    """Of the register comparison, given the sizes' shares of their sum (SetSketch's joint model)."""
    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    greater, smaller = p(share_a - share_b * similarity), p(share_b - share_a * similarity)
    tiny = 1e-12
    return more * np.log(np.maximum(greater, tiny)) + less * np.log(np.maximum(smaller, tiny)) \
        + same * np.log(np.maximum(1 - greater - smaller, tiny))


def likely(reg_a: np.ndarray, reg_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of at least ``threshold`` is not ruled out, per pair."""
    more, less = (reg_a > reg_b).sum(axis=1)[:, None], (reg_a < reg_b).sum(axis=1)[:, None]
    same = reg_a.shape[1] - more - less
    share = (size_a / (size_a + size_b))[:, None]
    most = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    best = _log_likelihood(grid, share, 1 - share, more, less, same).max(axis=1)
    high = threshold + np.linspace(0, 1, 16)[None, :] * np.maximum(most - threshold, 0)[:, None]
    there = _log_likelihood(high, share, 1 - share, more, less, same).max(axis=1)
    return (most >= threshold - 1e-12) & (there >= best - MARGIN)


def _candidates(pairs: DataFrame, classes: DataFrame, threshold: float, kind: str) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and registers do not rule out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"),
                                    F.col("registers").alias(f"reg_{x}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            reg = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                   for c in ("reg_a", "reg_b")]
            size = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")]
            keep = likely(reg[0], reg[1], size[0], size[1], threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "reg_a", "reg_b")
    return map_batches(rows, run, f"a {kind}, b {kind}")


def _links(pairs: DataFrame, known: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    side = lambda x: known.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches):
        words = Words(lower=True)
        for batch in batches:
            keep, last, own = [], None, None
            others = words.rows(batch.column("text_b"))
            centres = batch.column("text_a")
            for k, other in enumerate(others):
                if centres[k] != last:                      # pairs of one centre mostly come together
                    last = centres[k]
                    own = shingle_set(words.of(centres.slice(k, 1))[0], width)
                theirs = shingle_set(other, width)
                both = len(np.intersect1d(own, theirs, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(theirs) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return map_batches(rows, run, f"a {kind}, b {kind}")


def _shape(edges: DataFrame) -> tuple:
    """What changes as long as the stars do."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(u, v)``: the smallest node reachable, by
    alternating large and small stars. A node's neighbours are never gathered: each star is a
    minimum per node joined back to its edges."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct(), "edges")
    shape = _shape(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # both sides of the joins are read from tables, so that the edges of a hub can be split
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        # now every edge points from a node (u) to a smaller one (v)
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = _shape(edges)
        if now == shape:
            break
        shape = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _prefix_pairs(rest: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """Pairs of ``rest(rep, comp, text)`` of different components that may reach the threshold:
    100 * shared >= percent * (n + n' - shared)."""

    def run(batches):
        words = Words(lower=True)
        for batch in batches:
            sets = [shingle_set(ids, width) for ids in words.rows(batch.column("text"))]
            size = np.array([len(s) for s in sets], np.int64)
            row = pa.array(np.repeat(np.arange(len(sets)), size))
            shingle = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(row), batch.column("comp").take(row), pa.array(np.repeat(size, size)),
                 pa.array(shingle)], ["rep", "comp", "n", "shingle"])

    rows = written(map_batches(rest, run, f"rep {kind}, comp {kind}, n bigint, shingle bigint"), "shingles")
    counts = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "shingle-counts")
    heavy = heavy_of_counts(counts, ["shingle"], "holders", HEAVY)
    counted = split_join(rows, counts, ["shingle"], heavy, ["rep"]).withColumn("holders", F.coalesce("holders", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("holders", "shingle"))
    # shingles from this one on; of the first that two sets share, it bounds what they share
    first = counted.withColumn("left", F.col("n") - place + 1) \
        .where((100 * F.col("left") >= percent * F.col("n")) & (F.col("holders") > 1)) \
        .select("shingle", "rep", "comp", "n", "left")
    first = written(first, "prefixes")
    enough = lambda left, n, other: (100 + percent) * left >= percent * (n + other)
    met = first.groupBy("shingle").agg(F.min("n").alias("least"), F.min("comp").alias("c"), F.max("comp").alias("d")) \
        .where("c < d").select("shingle", "least")
    open_ = split_join(first, met, ["shingle"], heavy, ["rep"], "inner").where(enough(F.col("left"), F.col("n"), F.col("least"))).drop("least")
    met = open_.groupBy("shingle").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c < d")
    open_ = written(split_join(open_, met.select("shingle"), ["shingle"], heavy, ["rep"], "inner"), "prefixes")
    x, y = open_.alias("x"), open_.alias("y")
    both = F.least("x.left", "y.left")
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rep") < F.col("y.rep"))
                  & (F.col("x.comp") != F.col("y.comp")) & enough(both, F.col("x.n"), F.col("y.n"))) \
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _components(sketches: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(words_key, component_id, keeper)`` of the classes of equal word sequences: the smallest id of
    the component, and the smallest class that has this id."""
    kind = "bigint"
    real = sketches.where("n_shingles > 0 and id is not null")
    least = real.groupBy("words_key").agg(F.min("id").alias("least"))
    classes = real.join(least, "words_key").where("id = least").dropDuplicates(["words_key"]) \
        .select("words_key", F.monotonically_increasing_id().alias("rep"), "id", "text_hash", "n_shingles", "registers", "bands")
    classes = written(classes, "classes")

    members = classes.select("rep", F.explode("bands").alias("bucket"))
    crowded = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "crowded")
    heavy = heavy_of_counts(crowded, ["bucket"], "size", HEAVY)
    members = written(split_join(members, crowded, ["bucket"], heavy, ["rep"], "inner"), "buckets")
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    members = members.drop("size").join(company, "rep")
    wanted = classes.join(company.select("rep"), "rep").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "rep")
    known = written(docs.join(wanted, ["_id", "_hash"]).select("rep", F.col("_text").alias("text"))
                    .dropDuplicates(["rep"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        return written(_links(_candidates(pairs, classes, percent / 100, kind), known, width, percent, kind), "links")

    centres = members.groupBy("bucket").agg(F.max_by("rep", F.struct("company", "rep")).alias("a"))
    stars = written(split_join(members, centres, ["bucket"], heavy, ["rep"], "inner").where("rep <> a").select("bucket", "rep", "a"), "stars")
    links = verified(stars.select("a", F.col("rep").alias("b")).distinct())
    parts = connected(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = stars.select("bucket", "rep").join(parts, F.col("rep") == F.col("node"), "left") \
        .select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("c"), F.max("comp").alias("d")) \
        .where("c < d").select("bucket")
    rest = split_join(labelled, mixed, ["bucket"], heavy, ["rep"], "inner").select("rep", "comp").distinct().join(known, "rep")
    more = verified(_prefix_pairs(rest, width, percent, kind))
    if not more.isEmpty():
        parts = connected(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    # the numbers of classes say nothing about their ids
    own = F.struct("id", "words_key")
    parts = parts.join(classes.select("rep", "id", "words_key"), F.col("rep") == F.col("node"))
    first = parts.groupBy("component").agg(F.min(own).alias("first"))
    first = parts.join(first, "component").select("rep", "first")
    return classes.select("words_key", "rep", "id").join(first, "rep", "left") \
        .select("words_key", F.coalesce("first", own).alias("first")) \
        .select("words_key", F.col("first.id").alias("component_id"), F.col("first.words_key").alias("keeper"))


def _hash(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _labelled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, n_shingles, words_key, component_id, keeper)`` per row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _hash(text_col).alias("_hash"))
    sketches = written(sketch(docs, width), "sketches")
    label = _components(sketches, docs, width, percent)
    return sketches.select("id", "text_hash", "n_shingles", "words_key").join(label, "words_key", "left")


def near_components(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` per row of ``docs``: components of the links between
    sets of ``width``-word shingles with 100 * intersection >= ``percent`` * union."""
    return _labelled(docs, width, percent, id_col, text_col) \
        .select(F.col("id").alias(id_col), "n_shingles",
                F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each component, of its smallest id; all columns. Rows of one
    id with other words stay, of those with equal words (or none) one does. Rows without an id all stay."""
    found = written(_labelled(docs.where(F.col(id_col).isNotNull()), width, percent, id_col, text_col), "labels")
    keeps = F.col("words_key").isNull() | ((F.col("id") == F.col("component_id")) & (F.col("words_key") == F.col("keeper")))
    stays = found.where(keeps).groupBy("id", "words_key").agg(F.min("text_hash").alias("text_hash"))
    of, text_hash, gone_hash, row = unused(docs, "_llm_id", "_llm_hash", "_llm_gone", "_llm_row")
    gone = found.select("id", "text_hash").distinct().join(stays.select("id", "text_hash"), ["id", "text_hash"], "left_anti") \
        .select(F.col("id").alias(of), F.col("text_hash").alias(gone_hash))
    left = docs.where(F.col(id_col).isNotNull()).withColumn(text_hash, _hash(text_col))
    left = left.join(gone, (F.col(id_col) == F.col(of)) & (F.col(text_hash) == F.col(gone_hash)), "left_anti")
    again = F.row_number().over(Window.partitionBy(id_col, text_hash).orderBy(text_hash))
    left = left.withColumn(row, again).where(F.col(row) == 1).drop(text_hash, row)
    return left.unionByName(docs.where(F.col(id_col).isNull()))
