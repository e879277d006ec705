"""Winnowing, periodic runs and the conversation trie against plain versions."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute as B  # noqa: E402

from mailsift.llm import queries, runs, trie, winnow  # noqa: E402


def _by(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def _docs(seed=3):
    rng = random.Random(seed)
    prose = lambda n, v=300: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    texts = [None, "", " \n", "a", "short text", "é" * 23, "é" * 24, "é" * 25, "汉字 \U0001F600 " * 40, "same " * 60,
             "a b " * 30, "x " * 24, "x " * 23, prose(400), prose(30), "\x00" * 90, " ".join("abc" * 9) + "  tail"]
    unit = prose(40).split()
    texts += [" ".join((unit[:k] * 9)[:k * 3 + j]) for k in (1, 7, 8, 9, 15, 16, 17, 31, 33) for j in (-1, 0, 5)]
    texts += [prose(20) + " " + " ".join(unit[:12] * 4) + " " + prose(9) + " " + " ".join(unit[:5] * 6), prose(3000)]
    texts += [prose(rng.randrange(5, 300), 3) for _ in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return rows + [rows[13], rows[13], (13, "another text of that id", None), (None, texts[13], None), (None, None, None),
                   (-4, texts[14], None)]


SCHEMA = "doc_id bigint, text string, prints string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(_docs(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_prints_are_the_rightmost_least_hashes():
    for k, window in ((winnow.K, winnow.WINDOW), (3, 4), (1, 1), (5, 7)):
        w = winnow.Winnower(k, window)
        rows = [t or "" for _, t, _ in _docs()]
        bounds, hashes, at = w.of(rows)
        for i, t in enumerate(rows):
            grams, pick = B.winnow(t, k, window)
            found = at[bounds[i]:bounds[i + 1]].tolist()
            # one text of all k-grams, each alone, gives the hashes they are ranked by
            alone, own, _ = w.of(grams) if k * window > 1 else (None, None, None)
            if own is None or len(grams) != len(own):
                continue
            rank = {g: int(h) >> 32 for g, h in zip(grams, own.tolist())}
            assert found == pick(rank), (k, window, t)
            assert [int(h) for h in hashes[bounds[i]:bounds[i + 1]]] == [int(own[p]) for p in found]


def test_prints_do_not_depend_on_chunks(monkeypatch):
    rows = [t or "" for _, t, _ in _docs()]
    want = [x.tolist() for x in winnow.Winnower().of(rows)]
    monkeypatch.setattr(winnow, "CHUNK", 100)
    assert [x.tolist() for x in winnow.Winnower().of(rows)] == want


def test_a_shared_passage_is_found():
    rng = random.Random(5)
    span = winnow.K + winnow.WINDOW - 1
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    w = winnow.Winnower()
    for _ in range(50):
        passage = text(span)
        bounds, hashes, _ = w.of([text(rng.randrange(300)) + passage + text(rng.randrange(300)) for _ in range(2)])
        assert set(hashes[:bounds[1]].tolist()) & set(hashes[bounds[1]:].tolist())


def test_op11_query(spark, folder):
    got = _by(queries.QUERIES["op11_fingerprints"](spark, folder).collect())
    rows = [(r["doc_id"], r["text"] or "", r["h"]) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    w = winnow.Winnower()

    def prints(t):
        _, hashes, at = w.of([t])
        return ",".join(f"{h:016x}:{p}" for h, p in zip(hashes.tolist(), at.tolist())), set(hashes.tolist())

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for (i, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1]):
        part = len(text) // 3
        edited = text[:len(text) - part] + after[:part]
        (own, a), (changed, b), (_, c) = prints(text), prints(edited), prints(after)
        want.append((i, len(text), B.sha(edited), own, changed, alike(a, b), alike(a, c)))
    assert got == _by(want)
    small = winnow.edited_fingerprints(spark.read.parquet(f"{folder}/documents.parquet"), block_chars=500).collect()
    assert _by((r["doc_id"], r["n_chars"], r["near_edited"], r["near_next"]) for r in small) == _by((*r[:2], *r[5:]) for r in want)


def test_prints_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = winnow.fingerprints(docs.withColumnRenamed("doc_id", "prints_id"), id_col="prints_id", k=4, window=3)
    w = winnow.Winnower(4, 3)
    want = []
    for i, t, _ in _docs():
        _, hashes, at = w.of([t or ""])
        want.append((i, len(t or ""), list(zip(hashes.view(np.int64).tolist(), at.tolist()))))
    assert _by((r[0], r[1], [tuple(p) for p in r[2]]) for r in got.collect()) == _by(want)


def test_one_document_follows_itself(spark):
    one = spark.createDataFrame([(1, "word " * 50)], "doc_id bigint, text string")
    got = winnow.edited_fingerprints(one).collect()
    assert [(r["n_chars"], r["near_next"]) for r in got] == [(250, 1.0)]


def test_transform_gives_the_squared_differences():
    rng = np.random.default_rng(2)
    for size in (8, 32):
        b, w = rng.integers(0, 5000, (4, size)), rng.integers(0, 5000, (4, 2 * size))
        want = [[int(((b[r] - w[r, d:d + size]) ** 2).sum()) % runs.PRIME for d in range(size)] for r in range(4)]
        assert runs.mismatches(b.astype(np.uint64), w.astype(np.uint64)).tolist() == want


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        x, alphabet = [], rng.choice([1, 2, 3, 50])
        while len(x) < rng.randrange(1, 500):
            unit = [rng.randrange(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
            x += (unit * rng.randrange(1, 9))[:rng.randrange(1, 200)] + [rng.randrange(1000) for _ in range(rng.randrange(4))]
        assert runs.find(np.array(x)) == B.runs(x)


def test_op12_query(spark, folder):
    want = [B.runs_row(i, t) for i, t, _ in _docs()]
    assert _by(queries.QUERIES["op12_periodic_runs"](spark, folder).collect()) == _by(want)


def test_runs_of_a_batch_stay_in_their_documents(spark):
    df = spark.createDataFrame(_docs(), SCHEMA).coalesce(1)
    got = runs.find_runs(df, batch_words=60).collect()
    want = [(i, len(B.WORD.findall(t or "")), B.runs(B.WORD.findall(t or ""))) for i, t, _ in _docs()]
    assert _by((r[0], r[1], [tuple(x) for x in r[2]]) for r in got) == _by(want)


def _turns():
    rng = random.Random(4)
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(["u", "a"]), rng.choice(["hi", "yes", "é" * 3])) for t in range(rng.randrange(1, 12))]
    deep = [(t, "u", f"t{t % 3}") for t in range(300)]                    # long chains, one ending inside another
    rows += [(100, *x) for x in deep] + [(101, *x) for x in deep] + [(102, *x) for x in deep[:200]]
    rows += [(100 + 5 * k, 0, "u", "copy") for k in range(1, 60)]         # many ends of one node
    rows += [(500, None, None, None), (500, 3, "u", ""), (500, None, None, None), (1 << 40, 1, "z", "far"), (None, 1, "u", "x")]
    return [(*r, "k") for r in rows]


def test_op13_query(spark, tmp_path):
    df = spark.createDataFrame(_turns(), "conv_id bigint, turn bigint, role string, text string, conv string")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_conversation_trie"](spark, str(tmp_path)).collect()
    assert _by(got) == _by(B.trie([r[:4] for r in _turns()]))


def test_trie_of_any_table(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHAIN_PART", 20)
    rows = [r for r in _turns() if r[0] is None or r[0] < 1000]
    df = spark.createDataFrame(rows, "c int, t bigint, r string, x string, conv string")
    got = trie.conversation_trie(df, "c", "t", "r", "x")
    assert _by(got.collect()) == _by(B.trie([r[:4] for r in rows], rebuild=False))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert winnow.fingerprints(docs).count() == winnow.edited_fingerprints(docs).count() == runs.find_runs(docs).count() == 0
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie.conversation_trie(none).count() == 0
