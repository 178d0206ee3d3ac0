"""Operator 12 against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from llm_helpers import SF, docs_of

from latentlake.llm import periodic
from latentlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, exponent=4, least=6):
    """Each period in turn: maximal stretches of equal words q apart; a stretch that a smaller period has is not smallest."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc, text):
    words = planted(doc, WORD.findall(text or ""))
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12(spark, documents):
    want = sorted(expected(d, t) for d, t, _ in documents)
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect())
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10


@pytest.mark.parametrize(("exponent", "least"), [(2, 2), (3, 7), (4, 6)])
def test_runs(exponent, least):
    """Random words over small alphabets, powers of short roots, and Fibonacci and Thue-Morse words, several texts to a block."""
    rng = np.random.default_rng(exponent)
    for trial in range(150):
        texts = []
        for _ in range(int(rng.integers(1, 5))):
            root = rng.integers(1, int(rng.choice([2, 3, 4, 30])), int(rng.integers(1, 9)))
            parts = [np.tile(root, int(rng.integers(1, 9)))[: int(rng.integers(1, 60))], rng.integers(1, 4, int(rng.integers(0, 20)))]
            texts.append(np.concatenate([parts[i] for i in rng.permutation(2)]))
        fib = [[1], [1, 2]]
        while len(fib[-1]) < 90:
            fib.append(fib[-1] + fib[-2])
        texts += [np.array(fib[-1]), np.zeros(0, np.int64), np.array([1 + bin(i).count("1") % 2 for i in range(70)]), np.ones(75, np.int64)][trial % 4 :]
        ends = np.cumsum([len(t) for t in texts])
        s, e, d = periodic.runs(np.concatenate(texts).astype(np.int64), ends, exponent, least)
        begin = np.concatenate([[0], ends[:-1]]) + np.arange(len(texts))
        got = [sorted((int(a - b), int(z - a), int(q)) for a, z, q in zip(s, e, d, strict=True) if b <= a <= b + len(t)) for b, t in zip(begin, texts, strict=True)]
        assert got == [brute_runs(t.tolist(), exponent, least) for t in texts], trial


def test_wide_sort(monkeypatch):
    words = np.tile([1, 2, 3], 40)
    packed = periodic.runs(words, np.array([120]))
    monkeypatch.setattr(periodic, "PACKED", 1)
    monkeypatch.setattr(periodic, "JUMPS", 0)
    monkeypatch.setattr(periodic, "SLAB", 1)
    assert [x.tolist() for x in periodic.runs(words, np.array([120]))] == [x.tolist() for x in packed] == [[0], [120], [3]]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a b " * 4), (None, "a b " * 4), (4, "x " * 60_000), (4, "no runs here"), (5, "é é " * 5 + "é é"), (6, "a b c a b c a b c a")]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs_of(spark, rows)).collect()), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), *[(None, 8, [(0, 8, 2)], "a b")] * 2, (4, 60_000, [(0, 60_000, 1)], "x"), (4, 3, [], "no runs here"), (5, 6, [(0, 6, 1)], "é é"), (6, 10, [], rows[8][1])]
    assert got == sorted(want, key=str)
    loose = periodic.periodic_runs(docs_of(spark, rows[-1:]), exponent=2, least=2).first()["runs"]
    assert [tuple(x) for x in loose] == [(0, 10, 3)]
    assert periodic.periodic_runs(docs_of(spark, rows).limit(0)).collect() == []
    same = {(r["doc_id"], r["text"]) for r in periodic.with_planted_periods(docs_of(spark, rows[:5])).collect()}
    assert same == {tuple(r) for r in rows[:5]}
