"""Language identification by rank-order profiles (out-of-place distance).

A language's profile is its most frequent letter n-grams (1 to 3 letters, words padded with a
blank on either side) in rank order. A document's own n-grams are ranked the same way; every
n-gram adds the difference between its rank in the document and in the profile, or the profile
length if the profile lacks it. The language with the smallest sum wins.

N-grams are packed code points (21 bits a letter), so ties in frequency fall to the smaller code
and ranks are the same in every task. Profiles are summed per piece of text, per batch, then over
the corpus: one row per n-gram, language and batch is shuffled, and the best ranks are cut before
the ranking shuffle.

Null text or a text without a letter: ``und``, score 0. Rows without a language or outside the
training rows are predicted but not learned from. With nothing to learn from, all rows are
``und``. A language value is taken as it is; equal distances fall to the smaller value.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

PROFILE_SIZE = 300
UNDETERMINED = "und"
#: Languages (about) whose profiles a task holds at once.
LANGS_AT_ONCE = 256
#: Words counted at once.
_PIECE_WORDS = 50_000
#: Letters are the Unicode category L: numerals such as ² or Ⅷ are none.
_LETTERS = regex.compile(r"\p{L}+")


def _words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _counted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the words, each between blanks, and their counts, by n-gram code."""
    code = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = code != 32
    pair = (code[:-1] << 21) | code[1:]
    triple = (pair[:-1] << 21) | code[2:]
    # two words share a blank: n-grams around it belong to one of them, those across it to none
    grams = np.sort(np.concatenate([code[letter], pair, triple[letter[1:-1]]]))
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.diff(np.r_[first, len(grams)])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, the most frequent first, ties by code."""
    if len(codes) > size:
        enough = counts >= np.partition(counts, -size)[-size]
        codes, counts = codes[enough], counts[enough]
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   size: int = PROFILE_SIZE) -> DataFrame:
    """``(lang, gram, rank)``: at most ``size`` rows a language, ranks from 0."""

    def count(batches):
        for batch in batches:
            words, parts = defaultdict(list), defaultdict(list)
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()):
                words[lang] += _words(text)
                if len(words[lang]) > _PIECE_WORDS:
                    parts[lang].append(_counted(words.pop(lang)))
            for lang, rest in words.items():
                if rest:
                    parts[lang].append(_counted(rest))
            for lang, found in parts.items():
                codes, counts = _merged(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                    ["lang", "gram", "n"])

    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    counts = map_batches(rows, count, "lang string, gram bigint, n bigint")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # only a limit on the row number itself is applied before the shuffle as well
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size) \
        .select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class _Profiles:
    """Ranks of all profile n-grams as one sorted table: code by language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        self.codes = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        at, col = {c: k for k, c in enumerate(self.codes.tolist())}, {v: k for k, v in enumerate(self.langs)}
        for lang, code, rank in rows:
            self.ranks[at[code], col[lang]] = rank

    def predict(self, words: list[str]) -> tuple[str | None, float]:
        if not words or not self.langs:
            return None, 0.0
        top = _ranked(*_counted(words), self.size)
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        theirs = self.ranks[at]
        mine = np.arange(len(top))[:, None]
        distance = np.where(theirs < 0, self.size, np.abs(theirs - mine)).sum(axis=0)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(top)))


def _nearer(one: tuple[str | None, float], other: tuple[str | None, float]) -> tuple[str | None, float]:
    if one[0] is None or other[0] is None:
        return other if one[0] is None else one
    return min(one, other, key=lambda x: (-x[1], x[0]))


def predict_language(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     size: int = PROFILE_SIZE, langs_at_once: int = LANGS_AT_ONCE) -> DataFrame:
    """``(id, lang_pred, score)`` per row of ``docs``. The profiles (``size`` rows a language) are
    the only thing sent to the tasks, for about ``langs_at_once`` languages at a time: more values
    of a language take more steps in the same pass over the rows, each of which keeps the nearer."""
    profiles = written(profiles.select("lang", "gram", "rank"), "profiles")
    blocks = max(1, -(-profiles.select("lang").distinct().count() // langs_at_once))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.lit(None).cast("string").alias("lang_pred"),
                      F.lit(0.0).alias("score"), F.col(text_col).alias("_text"))
    for block in range(blocks):
        rows = [tuple(r) for r in profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).collect()]
        passed = ["_text"] if block < blocks - 1 else []

        def run(batches, rows=rows, passed=passed):
            known = _Profiles(rows, size)
            for batch in batches:
                so_far = zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist())
                found = [_nearer(old, known.predict(_words(t)))
                         for old, t in zip(so_far, batch.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array([x[0] for x in found], pa.string()),
                     pa.array([x[1] for x in found], pa.float64()), *map(batch.column, passed)],
                    ["_id", "lang_pred", "score", *passed])

        out = map_batches(out, run, f"_id {kind}, lang_pred string, score double" + ", _text string" * len(passed))
    return out.select(F.col("_id").alias(id_col), F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), "score")


def held_out(id_col: str = "doc_id") -> Column:
    """The fixed fold that is never learned from (a null id is held out as well)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))
