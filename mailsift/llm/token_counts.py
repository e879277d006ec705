"""Token counts of a sentencepiece BPE model by rank-synchronous merging of numpy arrays.

The text becomes what the model sees: blanks turn into U+2581, one more in front. No piece of the
vocabulary goes on behind a U+2581 that follows another character, so a text can be cut in front
of every run of U+2581 without losing a merge. Those pre-tokens repeat, so a task merges each
distinct one once per table and adds up counts.

A batch of new pre-tokens is one ragged array of symbol ids. In each round every pre-token looks up
the rank of all its neighbouring pairs (a pair's rank is that of the piece it forms), finds its
lowest, and merges all its occurrences, all pre-tokens of the batch at once. An occurrence whose new
piece forms a pair as good or better with its neighbours is the last of its round, since the library
would merge that pair next. What survives is counted, a character outside the vocabulary as its
UTF-8 bytes. Pre-tokens too long for many rounds (a text without blanks) merge by the same rule in
arrays with links, where a round touches the occurrences of one pair only.

Rows are independent: no shuffle. Null or empty text: 0 tokens, 0 bytes.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE_LIMIT, map_batches, texts

BLANK = "▁"
#: Pre-tokens above this length are merged in arrays with links (same rule and result): a round over
#: the whole of a long text for each rank would read it thousands of times.
LONG = 512
#: Occurrences of one pair that a round over linked arrays merges, at most.
CHUNK = 1 << 14
_NO_RANK = np.iinfo(np.int32).max


class PieceModel:
    """Vocabulary of a model file as arrays: symbols, ranks and the table of mergeable pairs."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces \
                or proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback \
                or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.prefix = BLANK if spec.add_dummy_prefix else ""
        kinds = proto.trainer_spec.model_type and pb.ModelProto.SentencePiece.Type
        if any(p.type in (kinds.Value("USER_DEFINED"), kinds.Value("UNUSED")) for p in proto.pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        score = {p.piece: p.score for p in proto.pieces if p.type == kinds.Value("NORMAL")}
        if any(BLANK in p.lstrip(BLANK) for p in score):
            raise ValueError("a piece spans a word boundary")
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.symbol = {p: k for k, p in enumerate(score)}
        self.rank = np.array([order[s] for s in score.values()], np.int32)
        pairs = {}
        for piece, k in self.symbol.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = k
        keys = sorted(pairs)
        self.pair_keys = np.array(keys, np.int64)
        self.pair_piece = np.array([pairs[k] for k in keys], np.int32)
        left, right = self.pair_keys >> 32, self.pair_keys & 0xFFFFFFFF
        made = self.rank[self.pair_piece]
        #: pieces whose merge may open a pair that is as good or better
        self.opens = np.zeros(len(score), bool)
        for side in (left, right):
            self.opens[side[made <= self.rank[side]]] = True

    def pre_tokens(self, text: str) -> list[str]:
        if not text:
            return []
        return _PRE_TOKEN.findall(self.prefix + text.replace(" ", BLANK))

    def symbols(self, token: str) -> list[int]:
        """Ids of the characters; one outside the vocabulary is minus its number of bytes."""
        known = self.symbol
        return [known[c] if c in known else -len(c.encode("utf-8", "surrogatepass")) for c in token]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair forms, -1 for none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_piece[at], -1)


_PRE_TOKEN = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def _survivors(symbols: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Tokens per owner: a symbol counts 1, a character outside the vocabulary its bytes."""
    return np.bincount(owner, weights=np.where(symbols < 0, -symbols, 1), minlength=n).astype(np.int64)


def _every_second(follows: np.ndarray) -> np.ndarray:
    """Of occurrences in order, ``follows`` where one overlaps the one before: those that merge when
    the leftmost goes first."""
    index = np.arange(len(follows))
    return (index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0


def _opens(model: PieceModel, made: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether a new piece forms a pair with its neighbours that is as good as its own rank, or better."""
    out = np.zeros(len(made), bool)
    at = np.flatnonzero(model.opens[made])
    if len(at):
        own = model.rank[made[at]]
        for piece in (model.pair(left[at], made[at]), model.pair(made[at], right[at])):
            out[at] |= (piece >= 0) & (model.rank[piece] <= own)
    return out


def merge_ragged(model: PieceModel, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each of many symbol sequences: each round merges the lowest-rank pair of every sequence."""
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    done = np.zeros(n, np.int64)
    while len(symbols):
        piece = np.full(len(symbols), -1, np.int32)
        piece[:-1] = np.where(owner[1:] == owner[:-1], model.pair(symbols[:-1], symbols[1:]), -1)
        rank = np.where(piece >= 0, model.rank[piece], _NO_RANK)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(rank, first)
        span = np.diff(np.r_[first, len(symbols)])
        live = np.repeat(lowest < _NO_RANK, span)
        if not live.all():                      # finished sequences leave the arrays
            done += _survivors(symbols[~live], owner[~live], n)
            symbols, owner, piece, rank = symbols[live], owner[live], piece[live], rank[live]
            span, lowest = span[lowest < _NO_RANK], lowest[lowest < _NO_RANK]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, span))
        at = at[_every_second(np.r_[False, (at[1:] == at[:-1] + 1) & (owner[at[1:]] == owner[at[:-1]])])]
        made, own = piece[at], owner[at]
        # neighbours as they are when the occurrences merge from left to right
        around, whose = np.r_[symbols, -1, -1], np.r_[owner, -1, -1]
        left = np.where(whose[at - 1] == own, around[at - 1], -1)
        left[1:] = np.where((at[1:] == at[:-1] + 2) & (own[1:] == own[:-1]), made[:-1], left[1:])
        opened = _opens(model, made, left, np.where(whose[at + 2] == own, around[at + 2], -1))
        if opened.any():                        # what comes after such a piece in its sequence waits
            before = np.cumsum(opened) - opened
            leftmost = np.r_[True, own[1:] != own[:-1]]
            go = before == np.maximum.accumulate(np.where(leftmost, before, 0))
            at, made = at[go], made[go]
        symbols[at] = made
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return done


def merge_linked(model: PieceModel, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each of a few long symbol sequences: each round merges the lowest-rank pair of all of them.

    The arrays keep their length; neighbours are linked, and the places of each rank are kept in a list, so
    that a round reads the occurrences of one pair and not the whole text."""
    n = len(symbols)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.r_[True, owner[1:] != owner[:-1]]
    symbols = np.r_[symbols, np.int32(-1)]              # the last entry stands for no neighbour
    left = np.r_[np.where(ends, n, np.arange(n) - 1), n]
    right = np.r_[np.where(np.r_[ends[1:], True], n, np.arange(n) + 1), n]
    alive = np.ones(n, bool)
    made = np.full(n + 1, -1, np.int32)
    rank = np.full(n + 1, _NO_RANK, np.int32)
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def offer(at: np.ndarray) -> None:
        """Look up the pairs that begin at these places."""
        made[at] = model.pair(symbols[at], symbols[right[at]])
        rank[at] = np.where(made[at] >= 0, model.rank[made[at]], _NO_RANK)
        at = at[made[at] >= 0]
        at = at[np.argsort(rank[at], kind="stable")]
        for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
            r = int(rank[part[0]])
            if r not in places:
                places[r] = []
                heapq.heappush(ranks, r)
            places[r].append(part)

    offer(np.arange(n))
    while ranks:
        r = ranks[0]
        at = np.sort(np.concatenate(places[r]), kind="stable")
        at, rest = at[:CHUNK], at[CHUNK:]
        at = np.unique(at[rank[at] == r])
        at = at[_every_second(np.r_[False, right[at[:-1]] == at[1:]])] if len(at) else at
        if len(at):
            new, second = made[at], right[at]
            before = symbols[left[at]]
            before[1:] = np.where(second[:-1] == left[at[1:]], new[:-1], before[1:])
            opened = _opens(model, new, before, symbols[right[second]])
            if opened.any():                    # what comes after such a piece waits
                last = int(opened.argmax()) + 1
                rest = np.r_[at[last:], rest]
                at, new, second = at[:last], new[:last], second[:last]
        if len(rest):
            places[r] = [rest]
        else:
            del places[r]
            heapq.heappop(ranks)
        if len(at):
            symbols[at] = new
            alive[second], rank[second] = False, _NO_RANK
            right[at] = right[second]
            left[right[at]] = at
            offer(np.setdiff1d(np.r_[at, left[at]], [n]))
    return _survivors(symbols[:n][alive], owner[alive], len(lengths))


class TokenCounts(dict):
    """Pre-token to number of tokens, filled in batches and kept while it is small."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def learn(self, tokens: set[str]) -> None:
        if len(self) + len(tokens) > WORD_TABLE_LIMIT:
            self.clear()
        new = sorted((t for t in tokens if t not in self), key=len)
        cut = bisect_right(new, LONG, key=len)
        for merge, some, size in ((merge_ragged, new[:cut], 50_000), (merge_linked, new[cut:], 1_000)):
            for k in range(0, len(some), size):
                part = some[k:k + size]
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                symbols = np.array(self.model.symbols("".join(part)), np.int32)
                self.update(zip(part, merge(self.model, symbols, lengths).tolist()))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` per row of ``docs``; the model file's bytes go to the tasks."""
    with open(model_path, "rb") as f:
        model_bytes = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        known = TokenCounts(PieceModel(model_bytes.value))
        for batch in batches:
            found = [known.model.pre_tokens(t) for t in texts(batch, "_text")]
            known.learn({w for words in found for w in words})
            n = [sum(map(known.__getitem__, words)) for words in found]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())],
                                             ["_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                      f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumnRenamed("_id", id_col)
