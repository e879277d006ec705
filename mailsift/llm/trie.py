"""The prefix trie of conversations, and totals over all its subtrees by tree contraction.

A node is a distinct sequence of first turns (role, text); conversations that begin with it are its
members. The root, depth 0, has all of them. A node is named by its smallest member and its depth.

1. **Order.** Turns are range-partitioned by (conversation, order) and written with the number of
   their range; a turn's number is its rank in the range plus the turns of its conversation in earlier
   ranges. Only a range's first conversation has any, so the driver sees one row per range, and a
   conversation of any length is spread over ranges.
2. **Prefixes.** Each (depth, role, text) has a 128-bit hash; the key of a prefix is the xor of its
   turns' hashes, again a running value inside a range and a carried one. A parent's key is its
   child's without the last turn. Nodes are one aggregation by key (partial before the shuffle).
3. **Contraction.** Every node has a weight of its own (1 if it is a leaf, and its savings).
   *Compress*: nodes with one child form chains; pointer doubling joins each with the pointer it
   points to until all point to the first node below the chain, with the weights in between. The
   chains leave the tree, their weights go to the node above them. *Rake*: leaves leave the tree, their
   totals are final and are added to their parents. After a compress at least half of the nodes
   are leaves, so rounds are logarithmic in the leaves and joins in the longest chain. A node knows
   its last remaining child from the xor of its children's names.
4. **Re-expansion.** From the last round to the first, a chain's nodes add the total of the node
   below the chain to the weights in between.

Joins are by unique node names, on both sides, but for parents (many children: a join that adaptive
execution may split, both sides read from written tables) and for long chains (their nodes are dealt by their
distance from the end, ``CHAIN_PART`` to a task). ``ends_sha256`` hashes the ids of the members that
end at a node as one text; ids are packed by ranges of 65,536 before one task streams the pieces.

Null roles and texts count as empty. Turns without a conversation are left out. Turns of one
conversation with an equal place in the order follow by role, then by the hash of role and text;
repeated turns stand one after the other. Other columns are not read. No conversations: no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

#: Nodes of one chain that a task expands.
CHAIN_PART = 1000
#: Ids of a node's ends are packed by ranges of 2^PACK_BITS.
PACK_BITS = 16

NODE = ["conv", "depth"]
_KEY = ["depth", "k1", "k2"]
_TOTAL = ["leaves", "saved"]


def identified(turns: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text",
               keep: tuple[str, ...] = ("turn",)) -> DataFrame:
    """``(conv, *keep, role, h1, h2, n_bytes)``: a turn's conversation, identity and size."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    return turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), *keep, role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), role, text).alias("h2"), F.octet_length(text).cast("bigint").alias("n_bytes"))


def _in_ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` written by ranges of (conv, order), with the number of their range. Equal rows are
    told apart by where they were read, so that they do not make a range large."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    return written(tied.repartitionByRange(F.col("conv"), *order, F.col("_tie"))
                   .withColumn("_range", F.spark_partition_id()), "trie-ranges")


def _carried(rows: DataFrame, values: dict[str, Column], add: Callable[[tuple, tuple], tuple]) -> DataFrame:
    """``rows`` with ``_before_<name>``: the aggregates ``values`` over the turns of its conversation in
    earlier ranges, null where there are none. ``add`` combines two of them."""
    names = list(values)
    per = rows.groupBy("_range", "conv").agg(*[v.alias(n) for n, v in values.items()]) \
        .groupBy("_range").agg(F.min("conv").alias("first"), F.max("conv").alias("last"),
                               F.max_by(F.struct(*names), "conv").alias("tail")).collect()
    carried, before = [], None                  # before: the last conversation and its values so far
    for r in sorted(per, key=lambda r: r["_range"]):
        tail = tuple(r["tail"])
        if before is not None and before[0] == r["first"]:
            carried.append((r["_range"], r["first"], *before[1]))
            if r["first"] == r["last"]:
                tail = add(before[1], tail)
        before = (r["last"], tail)
    schema = "_at int, _of bigint" + "".join(f", _before_{n} bigint" for n in names)
    small = rows.sparkSession.createDataFrame(carried, schema)       # at most one row per range
    return rows.join(F.broadcast(small), (F.col("_range") == F.col("_at")) & (F.col("conv") == F.col("_of")), "left") \
        .drop("_at", "_of")


def numbered(turns: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``turns`` with their 1-based number in the conversation, ``out``."""
    order = [*order, F.col("role"), F.col("h1"), F.col("h2")]
    rows = _carried(_in_ranges(turns, order), {"n": F.count(F.lit(1))}, lambda a, b: (a[0] + b[0],))
    inside = Window.partitionBy("_range", "conv").orderBy(*order, "_tie")
    return rows.withColumn(out, F.row_number().over(inside) + F.coalesce("_before_n", F.lit(0))) \
        .drop("_before_n")


def prefixes(turns: DataFrame, order: list[Column]) -> DataFrame:
    """``(conv, depth, k1, k2, p1, p2, n_bytes)``: each prefix of each conversation, its key, the key
    without its last turn, and that turn's bytes. ``turns`` are ``identified``."""
    rows = numbered(turns, order, "depth")
    rows = rows.withColumn("t1", F.xxhash64("depth", "h1", "h2")).withColumn("t2", F.xxhash64("h2", "depth", "h1"))
    rows = _carried(rows, {"x1": F.bit_xor("t1"), "x2": F.bit_xor("t2")}, lambda a, b: (a[0] ^ b[0], a[1] ^ b[1]))
    inside = Window.partitionBy("_range", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    for n in "12":
        rows = rows.withColumn(f"k{n}", F.bit_xor(f"t{n}").over(inside).bitwiseXOR(F.coalesce(f"_before_x{n}", F.lit(0)))) \
            .withColumn(f"p{n}", F.col(f"k{n}").bitwiseXOR(F.col(f"t{n}")))
    return rows.select("conv", "depth", "k1", "k2", "p1", "p2", "n_bytes")


def _names(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_{c}").alias(c) for c in NODE]


def _rooted_chains(active: DataFrame) -> DataFrame:
    """For each node with one child, ``(conv, depth, up_conv, up_depth, to_conv, to_depth, hops, leaves,
    saved)``: the first node below that has not, its distance, and the weights from the node to there."""
    start = active.where("n_kids = 1 AND depth > 0").select(
        *NODE, "up_conv", "up_depth", F.col("kid_conv").alias("to_conv"), F.col("kid_depth").alias("to_depth"),
        F.lit(1).cast("bigint").alias("hops"), *_TOTAL, F.lit(True).alias("open"))
    state = written(start, "trie-chains")
    while state.where("open").limit(1).count():
        beyond = state.select(F.col("conv").alias("to_conv"), F.col("depth").alias("to_depth"),
                              *[F.col(c).alias(f"b_{c}") for c in ("to_conv", "to_depth", "hops", *_TOTAL)])
        more = lambda c: F.col(c) + F.coalesce(f"b_{c}", F.lit(0))
        # pointers into a chain are all different, so neither side has a hot key
        jumped = state.where("open").join(beyond, ["to_conv", "to_depth"], "left").select(
            *NODE, "up_conv", "up_depth", F.coalesce("b_to_conv", "to_conv").alias("to_conv"),
            F.coalesce("b_to_depth", "to_depth").alias("to_depth"), *[more(c).alias(c) for c in ("hops", *_TOTAL)],
            F.col("b_to_conv").isNotNull().alias("open"))
        state = written(jumped.unionByName(state.where("NOT open")), "trie-chains")
    return state.drop("open")


def _compress(active: DataFrame, chains: DataFrame) -> DataFrame:
    """``active`` without the nodes of ``chains``: their weights go to the node above."""
    top = chains.groupBy("to_conv", "to_depth").agg(
        F.max_by(F.struct("conv", "depth", "up_conv", "up_depth", *_TOTAL), "hops").alias("t")) \
        .select("to_conv", "to_depth", "t.*")
    below = top.select(*_names("to"), F.col("up_conv").alias("new_conv"), F.col("up_depth").alias("new_depth"))
    above = top.groupBy("up_conv", "up_depth").agg(
        *[F.sum(c).alias(f"add_{c}") for c in _TOTAL],
        *[F.bit_xor(F.col(c).bitwiseXOR(F.col(f"to_{c}"))).alias(f"turn_{c}") for c in NODE]) \
        .select(*_names("up"), *[f"add_{c}" for c in _TOTAL], *[f"turn_{c}" for c in NODE])
    return active.where("n_kids <> 1 OR depth = 0").join(below, NODE, "left").join(above, NODE, "left").select(
        *NODE, F.coalesce("new_conv", "up_conv").alias("up_conv"), F.coalesce("new_depth", "up_depth").alias("up_depth"),
        "n_kids", *[F.col(f"kid_{c}").bitwiseXOR(F.coalesce(f"turn_{c}", F.lit(0))).alias(f"kid_{c}") for c in NODE],
        *[(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in _TOTAL])


def _rake(active: DataFrame) -> DataFrame:
    """``active`` without its leaves: their totals go to their parents."""
    above = active.where("n_kids = 0 AND depth > 0").groupBy("up_conv", "up_depth").agg(
        F.count(F.lit(1)).alias("less"), *[F.sum(c).alias(f"add_{c}") for c in _TOTAL],
        *[F.bit_xor(c).alias(f"turn_{c}") for c in NODE]) \
        .select(*_names("up"), "less", *[f"add_{c}" for c in _TOTAL], *[f"turn_{c}" for c in NODE])
    return active.where("n_kids > 0 OR depth = 0").join(above, NODE, "left").select(
        *NODE, "up_conv", "up_depth", (F.col("n_kids") - F.coalesce("less", F.lit(0))).alias("n_kids"),
        *[F.col(f"kid_{c}").bitwiseXOR(F.coalesce(f"turn_{c}", F.lit(0))).alias(f"kid_{c}") for c in NODE],
        *[(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in _TOTAL])


def _expand(chains: DataFrame, totals: DataFrame) -> DataFrame:
    """The totals of the nodes of ``chains``."""
    part = F.floor(F.col("hops") / CHAIN_PART)
    ends = chains.groupBy("to_conv", "to_depth").agg(F.max(part).alias("parts")) \
        .join(totals.select(F.col("conv").alias("to_conv"), F.col("depth").alias("to_depth"),
                            *[F.col(c).alias(f"b_{c}") for c in _TOTAL]), ["to_conv", "to_depth"]) \
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), "parts"))).drop("parts")
    return chains.withColumn("part", part).join(ends, ["to_conv", "to_depth", "part"]) \
        .select(*NODE, *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in _TOTAL])


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``(conv, depth, leaves, saved)`` summed over each node's subtree. ``tree`` has the nodes
    ``(conv, depth, up_conv, up_depth, leaves, saved)``; the root has depth 0 and no parent."""
    kids = tree.where("depth > 0").groupBy("up_conv", "up_depth").agg(
        F.count(F.lit(1)).alias("n_kids"), F.bit_xor("conv").alias("kid_conv"), F.bit_xor("depth").alias("kid_depth")) \
        .select(*_names("up"), "n_kids", "kid_conv", "kid_depth")
    active = written(tree.join(kids, NODE, "left").select(
        *NODE, "up_conv", "up_depth", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_kids", "kid_conv", "kid_depth")],
        *_TOTAL), "trie-active")
    rounds = []
    while active.where("depth > 0").limit(1).count():
        chains = _rooted_chains(active)
        short = written(_compress(active, chains), "trie-active")
        rounds.append((chains, short.where("n_kids = 0 AND depth > 0").select(*NODE, *_TOTAL)))
        active = written(_rake(short), "trie-active")
    totals = [active.select(*NODE, *_TOTAL)]
    for chains, leaves in reversed(rounds):
        totals.append(leaves)
        totals.append(written(_expand(chains, reduce(DataFrame.unionByName, totals)), "trie-totals"))
    return reduce(DataFrame.unionByName, totals)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` of ``(conv, depth, k1, k2)``, a row per conversation."""
    packed = ends.groupBy(*_KEY, F.shiftright("conv", PACK_BITS).alias("pack")) \
        .agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")) \
        .repartition(*_KEY).sortWithinPartitions(*_KEY, "pack").select(*_KEY, "ids")

    def stream(batches):
        node, state = None, None

        def out(nodes):
            return pa.RecordBatch.from_arrays(
                [pa.array([n[k] for n, _ in nodes], pa.int64()) for k in range(3)]
                + [pa.array([s.hexdigest() for _, s in nodes], pa.string())], [*_KEY, "ends_sha256"])
        for batch in batches:
            closed = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if at != node:
                    if node is not None:
                        closed.append((node, state))
                    node, state = at, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield out(closed)
        if node is not None:
            yield out([(node, state)])

    return map_batches(packed, stream, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, order: list[Column], conversations: DataFrame) -> DataFrame:
    """The nodes ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)``. ``turns`` are ``identified``, in the order given; ``conversations`` has the ids
    ``conv`` of all of them, without repeats, also of those without turns."""
    out = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, " \
          "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    spark = turns.sparkSession
    n_all, root = conversations.agg(F.count("conv"), F.min("conv")).first()
    if not n_all:
        return spark.createDataFrame([], out)
    paths = written(prefixes(turns, order).withColumn("depth", F.col("depth").cast("bigint")), "trie-prefixes")
    nodes = written(paths.groupBy(*_KEY).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2")), "trie-nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                      F.col("conv").alias("up_conv"))
    below = nodes.where("depth > 1").join(up, ["depth", "p1", "p2"], "left").select(*nodes.columns, "up_conv") \
        .unionByName(nodes.where("depth = 1").withColumn("up_conv", F.lit(root)))
    top = spark.createDataFrame([(root, 0, 0, 0, n_all, 0)], "conv bigint, depth bigint, k1 bigint, k2 bigint, n_convs bigint, n_bytes bigint") \
        .withColumn("up_conv", F.lit(None).cast("bigint"))
    tree = written(below.select(*top.columns).unionByName(top), "trie-tree")
    kids = tree.where("depth > 0").groupBy(F.col("up_conv").alias("conv"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    tree = written(tree.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-tree")
    totals = subtree_totals(tree.select(
        *NODE, "up_conv", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"),
        (F.col("n_children") == 0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")))
    last = paths.groupBy("conv").agg(F.max(F.struct(*_KEY)).alias("at")).select("conv", "at.*")
    ends = conversations.join(last, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _KEY])
    return tree.join(totals, NODE).join(_end_hashes(ends), _KEY, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``prefix_trie`` of a table of turns, ordered by ``turn_col`` (null first)."""
    turns = identified(conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                                            F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    return prefix_trie(turns, [F.col("turn").asc_nulls_first()], turns.select("conv").distinct())
