"""Operator 11 against brute force."""

import re

import numpy as np
import pytest
import xxhash
from llm_helpers import SF, docs_of

from latentlake.llm import components, simhash
from latentlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def labels(prints, bits):
    """Least position reachable by links, by comparing all pairs."""
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= bits
    label = np.arange(len(a))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_op11(spark, documents):
    ids = [d for d, _, _ in documents]
    prints = [print_of(t, 3) for _, t, _ in documents]
    want = {d: (f"{p:016x}", ids[c]) for d, p, c in zip(ids, prints, labels(prints, 3), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op11_simhash"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize(("bits", "longest", "mean"), [(3, 2048, 16), (3, 24, 1), (2, 4, 16), (1, 3, 0.05)])
def test_links(spark, monkeypatch, bits, longest, mean):
    """Random fingerprints, copies a few bits away, and a crowd in which all share five to seven bytes; with short lists every level is opened."""
    monkeypatch.setattr(simhash, "LIST", longest)
    monkeypatch.setattr(simhash, "MEAN_LIST", mean)
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    flips = lambda n: np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in base], np.uint64)
    crowd = base[0] ^ rng.integers(0, 1 << (16 if bits == 2 else 8), 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(base ^ flips(n) for n in (1, 2, 3, 4)), crowd, np.zeros(1, np.uint64)]))
    rows = [(int(x),) for x in prints.view(np.int64)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long").repartition(3), bits).collect()
    place = {x[0]: i for i, x in enumerate(rows)}
    u, v = (np.array([place[e[c]] for e in edges], np.int64) for c in ("u", "v"))
    assert (simhash.forest(len(rows), u, v) == labels(prints, bits)).all()


def test_long_list():
    rng = np.random.default_rng(3)
    prints = np.unique((np.uint64(0xABCDEF0123) << np.uint64(24)) | rng.integers(0, 1 << 14, 300, dtype=np.uint64))
    assert (simhash.long_list(prints, [5, 6, 7], 3) == labels(prints, 3)).all()


@pytest.mark.parametrize("held", [5, 200_000])
def test_components(spark, monkeypatch, held):
    """Chains, stars, repeats and self-loops; more edges than a task contracts go through rounds."""
    monkeypatch.setattr(components, "TASK_EDGES", held)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (7, 7), (130, 129), (500, 500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 131)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_defined_cases(spark):
    text = "one two three four five"
    rows = [(3, text), (None, text.upper()), (7, None), (2, ""), (9, " \t\n"), (4, "lone"), (4, "lone"), (None, "quite another text of its own"), (5, "wörd " * 50_000)]
    got = [tuple(r) for r in simhash.simhash_groups(docs_of(spark, rows), k=3).collect()]
    f = lambda t: f"{print_of(t, 3):016x}"
    zero = "0" * 16
    want = [(3, f(text), 3), (None, f(text), 3), (7, zero, 2), (2, zero, 2), (9, zero, 2), (4, f("lone"), 4), (4, f("lone"), 4), (None, f(rows[7][1]), None), (5, f(rows[8][1]), 5)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.simhash_groups(docs_of(spark, rows).limit(0)).collect() == []


def test_refuses_more_bits(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)
