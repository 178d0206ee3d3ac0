"""Operator 13 against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import SF, docs_of

from latentlake.llm import spelling
from latentlake.llm.queries import QUERIES


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counted(documents):
    words = Counter()
    for doc, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    """All words one edit away, by the strings that losing or masking one letter gives."""
    masks = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i] + "\0" + w[i + 1 :]].add(w)
    rows, form = {}, {}
    for w, n in counts.items():
        others = {o for i in range(len(w)) for o in masks[w[:i] + "\0" + w[i + 1 :]]} - {w}
        others |= {w[:i] + w[i + 1 :] for i in range(len(w))} & counts.keys()
        others |= {o for i in range(len(w) + 1) for o in masks[w[:i] + "\0" + w[i:]]}
        assert all(near(w, o) for o in others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        rows[w] = [form[w], None, n, len(others), counts[best] if form[w] else None]
    for w, r in rows.items():
        last = w
        while form[last]:
            last = form[last]
        r[1] = last
    return {w: tuple(r) for w, r in rows.items()}


def test_op13(spark, documents):
    want = expected(counted((d, t) for d, t, _ in documents))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()}
    assert got == want
    assert sum(r[0] is not None for r in want.values()) > 20


@pytest.mark.parametrize(("chunk", "part"), [(1024, 300_000), (3, 40)])
def test_forms(spark, monkeypatch, chunk, part):
    """Dense clouds of words over few letters, very long words, accents, ties, and blocks cut into chunks."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    rng = np.random.default_rng(chunk)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(5, 8)))) for _ in range(220)}
    words |= {"".join(rng.choice(list("xyzwvutsrq"), 9)) for _ in range(40)} | {"a" * 70, "a" * 69 + "b", "a" * 71, "a" * 134, "b" * 64 + "a" * 70, "ñandú", "nandú", "ÿÿÿÿÿ", "ÿÿÿÿ÷"}
    counts = {w: int(rng.integers(3, 9)) for w in words}
    got = {r[0]: tuple(r[1:]) for r in spelling.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == expected(counts)


def test_chains(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "ccccc": 5, "ccccd": 9}
    got = {r[0]: tuple(r[1:3]) for r in spelling.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {"aaaaa": ("aaaab", "bbbbb"), "aaaab": ("aaabb", "bbbbb"), "aaabb": ("aabbb", "bbbbb"), "aabbb": ("abbbb", "bbbbb"), "abbbb": ("bbbbb", "bbbbb"), "bbbbb": (None, "bbbbb"), "ccccc": (None, "ccccc"), "ccccd": (None, "ccccd")}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "HELLO hello Hello hallo"), (4, "hello-hello"), (4, "hello-hello"), (5, "Éclair éclair éclair éclair ÉCLAIR ÉCLAIR"), (6, "long" * 20_000)]
    words = spelling.with_lost_letters(spelling.word_runs(docs_of(spark, rows)))
    counts = spelling.frequent_words(words)
    assert {r["word"]: r["n"] for r in counts.collect()} == counted((r[0], r[1]) for r in rows)
    got = {r[0]: tuple(r[1:]) for r in spelling.spelling_forms(counts).collect()}
    assert got == expected(counted((r[0], r[1]) for r in rows))
    assert spelling.spelling_forms(counts.limit(0)).collect() == []
