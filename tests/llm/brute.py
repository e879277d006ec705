"""Plain versions of the operators' contracts, one document or one table at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, width):
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return set()
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))}


def near(rows, width, percent):
    """doc_id -> (n_shingles, component_id)"""
    sets = {i: shingles(t, width) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter(p for ids in holders.values() for p in combinations(sorted(ids), 2))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def secrets(text):
    text = text or ""
    kinds = {
        "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                              re.I | re.A), lambda m: len(m[1]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    found = {k: [(m.start(), m.end()) for m in p.finditer(text) if ok(m)] for k, (p, ok) in kinds.items()}
    spans = sorted((s, n, k, e) for n, (k, v) in enumerate(found.items()) for s, e in v)
    return {k: len(v) for k, v in found.items()}, ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def pii(text):
    text = text or ""

    def luhn(d):
        v = [int(c) for c in d[::-1]]
        return sum(v[::2] + [x * 2 - 9 * (x > 4) for x in v[1::2]]) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m)] for k, (p, ok) in kinds.items()}
    return {k: len(v) for k, v in found.items()}, ",".join(f"{k}:{s}:{e}" for k, v in found.items() for s, e in v)


def lines(rows, min_chars=20, min_docs=3):
    """For each (id, text): (n_lines, n_dropped, kept text)"""
    key = lambda x: lower_ascii(x.strip(" \t\n\r\x0b\x0c"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n, rep = len(words), len(inside)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 10 or 100 * rep > 20 * n)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def edits(item, part):
    """Least word edits between the item and any run of words in ``part``."""
    row = [0] * (len(part) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, v in enumerate(part, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (v != w)))
        row = new
    return min(row)


def plain_words(text):
    return [w for w in (re.sub(r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]", "", x) for x in WORD.findall(lower_ascii(text or ""))) if w]


def minimax(sizes, n):
    """Least possible largest sum of ``n`` contiguous parts."""
    best = [0] + [float("inf")] * len(sizes)
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    for _ in range(n):
        best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


def winnow(text, k, window):
    """Places of the fingerprints of a text, given a hash of its k-grams: ``(position, hash)``."""
    grams = [text[i:i + k] for i in range(max(1, len(text) - k + 1))] if text else []

    def pick(rank):
        out = set()
        for a in range(max(1, len(grams) - window + 1) if grams else 0):
            part = range(a, min(len(grams), a + window))
            least = min(rank[grams[i]] for i in part)
            out.add(max(i for i in part if rank[grams[i]] == least))
        return sorted(out)
    return grams, pick


def runs(words, least=24, exponent=3):
    """All maximal stretches (start, length, smallest period)."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, exponent * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


def with_periods(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs_row(doc_id, text):
    words = with_periods(doc_id, text)
    found = runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def trie(rows, rebuild=True):
    """The nodes of (conv_id, turn, role, text) rows, as the operator's columns."""
    own = defaultdict(list)
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    whole = dict(own)
    for c, turns in own.items() if rebuild else ():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k],
             sha(",".join(str(c) for c in m if len(whole[c]) == len(k)))) for k, m in members.items()]


def language(rows, size=300):
    """``(lang, score)`` per (doc_id, text, lang) row by out-of-place distance to profiles of the rows not held out."""
    def grams(text):
        count = Counter()
        for w in regex.findall(r"\p{L}+", (text or "").lower()):
            padded = f" {w} "
            for n in (1, 2, 3):
                count.update(g for g in (padded[k:k + n] for k in range(len(padded) - n + 1)) if g != " ")
        return count

    def ranked(count):
        # ties by the packed code of the n-gram
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return [g for g, _ in sorted(count.items(), key=lambda e: (-e[1], code(e[0])))[:size]]
    total = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and i is not None and not held_out(i):
            total[lang] += grams(text)
    profiles = {v: {g: k for k, g in enumerate(ranked(c))} for v, c in sorted(total.items()) if c}
    out = []
    for _, text, _ in rows:
        mine = ranked(grams(text))
        if not mine or not profiles:
            out.append(("und", 0.0))
            continue
        far = {v: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(mine)) for v, p in profiles.items()}
        best = min(far, key=lambda v: (far[v], v))
        out.append((best, 1 - far[best] / (size * len(mine))))
    return out
