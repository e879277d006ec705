"""Quality rules combined by weak supervision.

Each rule looks at a document's counts and votes *bad* (0), *good* (2) or abstains (1). Nobody
says which rules are right: expectation-maximisation estimates from their agreement how often each
rule is right when it votes. A document is kept when the posterior probability of *good* is at
least one half, so a bad vote of a rule that the others contradict does not reject it, and no rule
has to be passed.

The fit needs only how many documents show each pattern of votes. There are at most 3^7 = 2187
patterns whatever the size of the corpus, so the counts (a partial aggregation over all documents)
fit the driver and the posteriors go back as a table of that size.

Null or empty text: no words, all counts 0, rejected by the base rule. An empty table gives an
empty result. Repeated rows and null ids are judged like any other row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, map_batches, texts, window_hashes

RULES = ("symbols", "marks", "sentences", "dup_lines", "repeats", "capitals", "variety")
BAD, ABSTAIN, GOOD = 0, 1, 2
REPEAT_WINDOW = 5
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
MIN_WORDS = 10
#: Share of good documents before any vote.
CLASS_BALANCE = 0.5
_SENTENCE_END = re.compile(rb"[.!?](?:\n|$| [A-Z\xc3])").findall

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(ids: np.ndarray) -> int:
    """Words inside windows of five words that occur twice or more."""
    h = window_hashes(ids, REPEAT_WINDOW)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str, word_ids: np.ndarray) -> tuple[tuple[int, ...], int]:
    """The counts of one text (with its words) and its votes, a number of seven ternary digits."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(word_ids)
    chars = len(text) - sum(map(raw.count, BLANKS))
    symbols = sum(map(raw.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = _repeated(word_ids)
    stats = (n, chars, symbols, dup, repeats)
    if not n:
        return stats, 0
    data = np.frombuffer(raw, np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    digits = int(((data >= 48) & (data <= 57)).sum())
    marks = chars - digits - upper - lower - (len(raw) - len(text) and int(((data >= 192)).sum()))
    sentences = len(_SENTENCE_END(raw))
    distinct = len(np.unique(word_ids))
    vote = lambda bad, good=False: BAD if bad else GOOD if good else ABSTAIN
    votes = (
        vote(symbols > 0.1 * n),
        vote(marks > 0.4 * n, marks <= 0.3 * n),
        vote(n >= 40 and sentences < n / 60, n / 25 <= sentences <= n / 2),
        vote(len(lines) >= 3 and dup > 0.3 * len(lines)),
        vote(repeats > 0.1 * n),
        vote(upper > lower),
        vote(n >= MIN_WORDS and distinct < n ** 0.6),
    )
    code = 0
    for v in votes:
        code = 3 * code + v
    return stats, code


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, votes)`` per row."""

    def run(batches):
        words = Words()
        for batch in batches:
            rows = list(map(measure, texts(batch, "_text"), words.rows(batch.column("_text"))))
            cols = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(STATS))]
            votes = pa.array([r[1] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *cols, votes], ["_id", *STATS, "votes"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run,
                      f"_id {kind}, " + ", ".join(f"{s} bigint" for s in STATS) + ", votes int")
    return out.withColumnRenamed("_id", id_col)


def fit(counts: dict[int, int], steps: int = 500) -> dict[int, float]:
    """Expectation-maximisation over the vote patterns: pattern to P(good | votes).

    A rule's bad votes are right with one probability and its good votes with another; abstaining
    says nothing. Votes stay better than a coin, and the class balance is a parameter, which together
    tell the two classes apart. With no documents there is nothing to fit.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    votes = np.array([[p // 3 ** (len(RULES) - 1 - k) % 3 for k in range(len(RULES))] for p in patterns])
    said = np.concatenate([votes == GOOD, votes == BAD], axis=1).astype(float)
    sign = np.repeat([1.0, -1.0], len(RULES))
    right, prior = np.full(len(sign), 0.8), CLASS_BALANCE
    good = np.zeros(len(patterns))
    for _ in range(steps):
        odds = np.log(prior / (1 - prior)) + said @ (sign * np.log(right / (1 - right)))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
        agreed = np.where(sign > 0, (weight * good) @ said, (weight * (1 - good)) @ said)
        right = np.clip((agreed + 0.8) / (weight @ said + 1.0), 0.55, 0.995)
    return {p: float(round(x, 9)) for p, x in zip(patterns, good)}


def posteriors(stats: DataFrame) -> dict[int, float]:
    """The fit over all rows of ``stats``; at most 3^7 rows reach the driver."""
    return fit({r["votes"]: r["count"] for r in stats.groupBy("votes").count().collect()})


def base_failed():
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * rep > 20 * n)


def judge(stats: DataFrame) -> DataFrame:
    """``stats`` plus ``base_failed``, ``p_good`` and ``kept``."""
    spark = stats.sparkSession
    table = spark.createDataFrame(sorted(posteriors(stats).items()), "votes int, p_good double")
    out = stats.join(F.broadcast(table), "votes", "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Narrow after the fit: the
    votes are read again instead of shuffling texts to join them with their verdicts."""
    table = posteriors(quality_stats(docs, id_col, text_col))

    def run(batches):
        words = Words()
        for batch in batches:
            keep = []
            for t, ids in zip(texts(batch, text_col), words.rows(batch.column(text_col))):
                (n, *_, rep), votes = measure(t, ids)
                keep.append(n >= MIN_WORDS and 100 * rep <= 20 * n and table.get(votes, 1.0) >= 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
