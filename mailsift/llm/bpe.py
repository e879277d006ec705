"""Byte-level BPE encoding through a table of distinct words, and decoding.

Byte-level BPE never merges across the borders of its pre-tokens ("words"), so every word has one
encoding. ``encode`` works in blocks of documents:

1. A narrow pass splits the texts. A block keeps its documents as positions in the block's own list
   of distinct words; the list itself is cut into ``buckets`` by word hash, packed.
2. The lists meet by bucket. A word has one bucket, where it is encoded once however many blocks
   and documents hold it. Each list goes back to its block as a list of ids in the same order. A
   block asks for a word once, so the most frequent word costs one entry a block, not a third of all
   rows.
3. Positions and ids of a block meet by block id, and ids are joined back by position.

A block is at most ``block_chars`` of text (or one longer text); lists of one bucket are streamed.
The first pass is a written table, so block ids cannot differ between its two readers, and it is
bucketed by block, so the documents are not shuffled when their ids come.

``decode`` joins ids with the tokenizer's id-to-piece table (as many rows as its vocabulary, sent to
the tasks) and reads the bytes as UTF-8.

Null or empty text: no ids, decodes to the empty text. Each input row gives one output row, also with
a null or repeated id. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, texts, written_by

BLOCK_CHARS = 16 << 20
BUCKETS = 1024
#: Words joined with their ids at once.
_SLICE_WORDS = 500_000
#: Encoded words a task remembers within a bucket.
REMEMBERED = 2_000_000
# Fixed value: the pre-tokens of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _pack_numbers(x: np.ndarray) -> bytes:
    """Numbers as byte planes: equal high bytes stand together and deflate well."""
    return _zip(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return _zip(len(words).to_bytes(4, "little") + lengths.tobytes() + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    raw = _unzip(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


class Splitter:
    """Pre-tokens of a text; the special strings of the tokenizer are words of their own."""

    def __init__(self, config: dict):
        import regex
        pre = config["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or config["normalizer"] \
                or config["model"]["type"] != "BPE" or config["model"]["ignore_merges"]:
            raise ValueError("only byte-level BPE tokenizers without prefix space and normaliser are supported")
        special = [t["content"] for t in config["added_tokens"]]
        self.special = set(special)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = regex.compile(PATTERN).findall

    def __call__(self, text: str) -> list[str]:
        if self.at_special is None or not any(s in text for s in self.special):
            return self.words(text)
        out = []
        for part in self.at_special.split(text):
            out += [part] if part in self.special else self.words(part)
        return out


class _Positions(dict):
    """Distinct words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class _Block:
    """Documents of one block: their ids, lengths and word positions, and the distinct words."""

    def __init__(self):
        self.ids, self.lengths, self.positions, self.words, self.chars = [], [], [], _Positions(), 0

    def add(self, id_, words: list[str], chars: int) -> None:
        self.ids.append(id_)
        self.lengths.append(len(words))
        self.positions.append(np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words)))
        self.chars += chars

    def rows(self, block: int, buckets: int, id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
        """One row for the documents and one for each bucket of words. Words stand by falling
        frequency, which makes positions small numbers."""
        positions = np.concatenate(self.positions) if self.positions else np.empty(0, np.uint32)
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        by_count = np.argsort(-np.bincount(positions, minlength=len(words)), kind="stable")
        words = [words[k] for k in by_count.tolist()]
        rank = np.empty(len(words), np.uint32)
        rank[by_count] = np.arange(len(words), dtype=np.uint32)
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        lists = [[words[k] for k in part.tolist()] for part in np.split(order, first[1:])] if len(words) else []
        payload = [_pack_numbers(rank[positions])] + [_pack_words(x) for x in lists]
        n = len(payload)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array([None] + used.tolist(), pa.int32()),
             pa.array([self.ids] + [None] * (n - 1), pa.list_(id_type)),
             pa.array([_pack_numbers(np.array(self.lengths))] + [None] * (n - 1), pa.binary()),
             pa.array([_pack_numbers(bucket)] + [None] * (n - 1), pa.binary()),
             pa.array(payload, pa.binary())], names)


def split_blocks(docs: DataFrame, config: str, id_col: str, text_col: str, block_chars: int, buckets: int) -> DataFrame:
    """Rows of documents (``bucket`` null) and of word lists, by block."""
    names = ["block", "bucket", "ids", "lengths", "word_buckets", "payload"]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        split = Splitter(json.loads(config))
        number, block, id_type = TaskContext.get().partitionId() << 32, _Block(), None
        for batch in batches:
            id_type = batch.column("_id").type
            for id_, text in zip(batch.column("_id").to_pylist(), texts(batch, "_text")):
                block.add(id_, split(text), len(text))
                if block.chars >= block_chars:
                    yield block.rows(number, buckets, id_type, names)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.rows(number, buckets, id_type, names)

    return map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                       f"block bigint, bucket int, ids array<{kind}>, lengths binary, word_buckets binary, "
                       "payload binary")


def encode_words(lists: DataFrame, config: str) -> DataFrame:
    """``(block, bucket, lengths, ids)``: the word lists as lists of ids, each word encoded once."""

    def run(batches: Iterator[pa.RecordBatch]):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(config)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        at, known = None, {}
        for batch in batches:                       # rows come sorted by bucket
            out = []
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
                if bucket != at or len(known) > REMEMBERED:
                    at, known = bucket, {}
                words = _unpack_words(payload)
                new = [w for w in words if w not in known]
                encoded = tokenizer.encode_batch([w.decode("utf-8", "surrogatepass") for w in new],
                                                 add_special_tokens=False)
                known.update((w, e.ids) for w, e in zip(new, encoded))
                ids = [known[w] for w in words]
                out.append((_pack_numbers(np.fromiter(map(len, ids), np.uint32, len(ids))),
                            _pack_numbers(np.fromiter((i for x in ids for i in x), np.uint32))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array([x[0] for x in out], pa.binary()),
                 pa.array([x[1] for x in out], pa.binary())], ["block", "bucket", "lengths", "ids"])

    by_bucket = lists.repartition("bucket").sortWithinPartitions("bucket")
    return map_batches(by_bucket, run, "block bigint, bucket int, lengths binary, ids binary")


def _ragged_take(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values[s:s + n]`` for each start and length, joined."""
    total = np.cumsum(lengths)
    if not len(total):
        return values[:0]
    return values[np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1])]


class Speller:
    """The id-to-piece table, and texts of many id lists by it."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Of the lists between ``bounds``: one more than lists, from 0."""
        raw = _ragged_take(self.starts[ids], self.sizes[ids], self.data).tobytes()
        at = np.r_[0, np.cumsum(self.sizes[ids])][bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def _joined(documents: pa.Table, replies: pa.Table, id_name: str, speller: Speller | None) -> pa.Table:
    """Ids (and texts) of a block's documents, by position, some documents at a time."""
    replies = replies.sort_by("bucket")
    empty = [np.empty(0, np.uint32)]
    sizes = np.concatenate([*map(_unpack_numbers, replies["lengths"].to_pylist()), *empty]).astype(np.int64)
    ids = np.concatenate([*map(_unpack_numbers, replies["ids"].to_pylist()), *empty]).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    id_type = documents.schema.field("ids").type.value_type
    out = []
    for row in range(documents.num_rows):
        get = lambda c: documents[c][row].as_py()  # noqa: B023,E731
        place = np.empty(len(sizes), np.int64)      # of a word in the replies, which come by bucket
        place[np.argsort(_unpack_numbers(get("word_buckets")), kind="stable")] = np.arange(len(sizes))
        words = _unpack_numbers(get("payload"))
        ends = np.r_[0, np.cumsum(_unpack_numbers(get("lengths")), dtype=np.int64)]
        doc_ids = documents["ids"][row].values
        a = 0
        while a < len(doc_ids):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _SLICE_WORDS, "right")) - 1)
            word = place[words[ends[a]:ends[b]]]
            each = sizes[word]
            tokens = _ragged_take(starts[word], each, ids)
            bounds = np.r_[0, np.cumsum(each)][ends[a:b + 1] - ends[a]]
            part = {id_name: doc_ids.slice(a, b - a).cast(id_type),
                    "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens))}
            if speller:
                part["decoded"] = pa.array(speller.texts(tokens, bounds), pa.string())
            out.append(pa.table(part))
            a = b
    return pa.concat_tables(out)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS, decoded: bool = False) -> DataFrame:
    """``(id, ids array<int>)`` per row of ``docs``: the ids of a tokenizers file. With ``decoded``
    also the text that the ids spell, as ``decode`` gives it, in the same pass."""
    with open(tokenizer_path, encoding="utf-8") as f:
        config = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    settings = json.loads(config)
    outline = json.dumps({**settings, "model": {k: v for k, v in settings["model"].items() if k not in ("vocab", "merges")}})
    blocks = written_by(split_blocks(docs, outline, id_col, text_col, block_chars, buckets), "bpe-blocks", "block")
    replies = encode_words(blocks.where("bucket is not null").select("block", "bucket", "payload"), config)
    documents = blocks.where("bucket is null").select("block", "ids", "lengths", "word_buckets", "payload")

    pieces = docs.sparkSession.sparkContext.broadcast(piece_bytes(settings)) if decoded else None

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        return _joined(left, right, id_col, Speller(pieces.value) if pieces else None)

    return documents.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        join, f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decoded)


def piece_bytes(config: dict) -> list[bytes]:
    """The bytes of each id: byte-level vocabularies spell bytes with 256 printable characters,
    those bytes that print as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}
    vocab = config["model"]["vocab"] | {t["content"]: t["id"] for t in config["added_tokens"]}
    out = [b""] * (max(vocab.values()) + 1)
    for piece, k in vocab.items():
        out[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` plus the text of its ids. A null list stays null."""
    with open(tokenizer_path, encoding="utf-8") as f:
        pieces = encoded.sparkSession.sparkContext.broadcast(piece_bytes(json.loads(f.read())))
    names = encoded.columns
    at = names.index(ids_col)

    def run(batches):
        speller = Speller(pieces.value)
        for batch in batches:
            column = batch.column(at)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            found = speller.texts(ids, np.r_[0, np.cumsum(sizes)])
            out = [t if ok else None for t, ok in zip(found, column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, out_col])

    if out_col in names:
        raise ValueError(f"{out_col} is a column already")
    return map_batches(encoded, run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
