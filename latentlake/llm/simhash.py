"""Operator 11: SimHash near duplicates from a byte-position inverted index with count filtering.

1. A text's fingerprint: bit j is set if it is set in over half of the hashes (XXH64, seed 42) of its word shingles, repeats counted.
2. Eight bytes that differ in at most ``bits`` bits agree in at least ``8 - bits`` positions. Postings are keyed by position and byte, several
   of them at a time: a pair's first ``t`` agreements lie in its first ``t + bits`` positions, so each fingerprint has C(t + bits, t) postings
   of ``t`` positional bytes. ``t`` follows the number of fingerprints, so that lists stay short; every ``t`` gives the same pairs.
3. Lists longer than ``LIST`` are opened again under one more positional byte, up to the guaranteed minimum of agreements. What is still long
   then shares all but ``bits`` bytes; the few bit flips allowed there are looked up in a table of those bytes.
4. Inside a list the shared positional bytes of each pair are tallied, pairs below the guaranteed minimum go, the others are verified bit by
   bit. A task returns a spanning forest of the links that it finds, so that large groups of copies give few rows.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like others; fewer words than ``k`` are one shingle; a null
doc_id never names a component, a component without any other has a null one; repeated rows have equal fingerprints and stay rows of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, query, read, scratch_scope, settle, typed
from .components import components, forest
from .kernels import LOWER, U64, chunks, joined_words, spans_index, text_bytes, word_bounds

SEED = 42
#: Mean length of posting lists that the number of positional bytes in a key aims at.
MEAN_LIST = 16
#: Fingerprints of a list that one task tallies; longer lists are opened under one more byte.
LIST = 2048


def fingerprints(raw: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of each text."""
    starts, ends, first = word_bounds(raw, offsets)
    n = np.diff(first)
    out = np.zeros(len(n), U64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    buf, at = joined_words(raw, starts, ends)
    begin = np.concatenate([at, [len(buf)]])
    number = np.maximum(n[full] - k + 1, 1)
    head = spans_index(first[full], number)
    tail = head + np.repeat(np.minimum(n[full], k), number)
    buf, digest = buf.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(buf[a:b], SEED) for a, b in zip(begin[head].tolist(), (begin[tail] - 1).tolist(), strict=True)], U64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    tally = np.add.reduceat(bits, np.cumsum(number) - number, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * tally > number[:, None], axis=1).view(">u8").ravel()
    return out


def _prints(k: int):
    def work(batches):
        for b in chunks(batches, "text"):
            raw, offsets = text_bytes(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(LOWER[raw], offsets, k).view(np.int64))], ["doc_id", "fp"])

    return work


def places(t: int, bits: int) -> list[tuple[int, ...]]:
    """Positions of the postings of ``t`` bytes."""
    return list(combinations(range(t + bits), t))


def mask(positions: tuple[int, ...]) -> int:
    """The bytes at ``positions`` (0 is the highest) as a signed 64-bit mask."""
    return int(np.array(sum(0xFF << (56 - 8 * p) for p in positions), U64).view(np.int64))


def _postings(lists: list[tuple[int, ...]]) -> Column:
    return F.explode(F.array(*(F.lit(i).cast("tinyint") for i in range(len(lists)))))


def _list_key(lists: list[tuple[int, ...]]) -> Column:
    """The bytes that a posting's list shares."""
    masks = F.array(*(F.lit(mask(p)) for p in lists))
    return F.col("fp").bitwiseAND(F.element_at(masks, F.col("p").cast("int") + 1))


def _flips(bits: int, width: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(1, bits + 1) for c in combinations(range(width), r)], np.int64)


def long_list(fp: np.ndarray, free: list[int], bits: int) -> np.ndarray:
    """Component label of each of the distinct fingerprints that agree in all positions but ``free``, by looking up the bit flips allowed."""
    small = np.zeros(len(fp), np.int64)
    for p in free:
        small = (small << 8) | ((fp >> U64(56 - 8 * p)) & U64(0xFF)).astype(np.int64)
    width = 8 * len(free)
    row = np.full(1 << width, -1, np.int32)
    row[small] = np.arange(len(fp))
    label = np.arange(len(fp))
    for flip in _flips(bits, width):
        other = row[small ^ flip]
        u = np.flatnonzero(other > np.arange(len(fp)))
        if len(u):
            label = forest(len(fp), u, other[u], label)
    return label


def _tally(lists: list[tuple[int, ...]], bits: int, last: bool):
    masks = np.array([mask(p) for p in lists], np.int64).view(U64)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p, raw = pdf["p"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(U64)
        key = raw & masks[p]
        order = np.lexsort((key, p))
        p, raw, key = p[order], raw[order], key[order]
        names, node = np.unique(raw, return_inverse=True)
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (key[1:] != key[:-1])])) if len(p) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([new, [len(p)]]))
        us, vs = [], []
        for i in np.flatnonzero(size > LIST) if last else ():
            at = node[new[i] : new[i] + size[i]]
            label = long_list(names[at], [x for x in range(8) if x not in lists[p[new[i]]]], bits)
            us.append(at)
            vs.append(at[label])
        short = size <= LIST if last else np.ones(len(size), bool)
        behind = np.repeat(np.where(short, new + size, 0), size) - np.arange(len(p))  # rows of the list from here on
        at, step = np.flatnonzero(behind > 1), 1
        while len(at):
            differ = raw[at] ^ raw[at + step]
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            kept = np.flatnonzero(shared >= 8 - bits)
            kept = at[kept[np.bitwise_count(differ[kept]) <= bits]]
            us.append(node[kept])
            vs.append(node[kept + step])
            step += 1
            at = at[behind[at] > step]
        label = forest(len(names), np.concatenate([np.zeros(0, np.int64), *us]), np.concatenate([np.zeros(0, np.int64), *vs]))
        linked = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"u": names[linked].view(np.int64), "v": names[label[linked]].view(np.int64)})

    return work


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(u, v): edges that connect the distinct fingerprints ``fps`` (fp) as the pairs with at most ``bits`` differing bits do."""
    if not 0 < bits <= 3:
        raise ValueError("bits must be 1, 2 or 3")
    spark, n, need = fps.sparkSession, fps.count(), 8 - bits
    t = min(max(1, round(log(max(n / MEAN_LIST, 1), 256) + 0.5)), need)
    rows, found = fps.select("fp", _postings(places(t, bits)).alias("p")), []
    while True:
        lists, last = places(t, bits), t == need
        rows = rows.withColumn("key", _list_key(lists))
        cold, hot = rows, None
        if not last:
            hot = settle(rows.groupBy("p", "key").count().where(F.col("count") > LIST).select("p", "key"))
            hot = None if hot.isEmpty() else hot
            cold = rows if hot is None else rows.join(hot, ["p", "key"], "left_anti")
        parts = parts_for(spark, n * len(lists), 500_000)
        part = F.pmod(F.xxhash64("p", "key"), F.lit(parts))
        found.append(settle(cold.select("p", "fp", part.alias("part")).groupBy("part").applyInPandas(_tally(lists, bits, last), "u long, v long")))
        if hot is None:
            break
        longer = places(t + 1, bits)
        more = [[longer.index((*p, q)) for q in range(p[-1] + 1, t + 1 + bits)] for p in lists]
        child = F.element_at(F.array(*(F.array(*(F.lit(i).cast("tinyint") for i in m)) for m in more)), F.col("p").cast("int") + 1)
        rows, t = settle(rows.join(hot, ["p", "key"], "left_semi").select("fp", F.explode(child).alias("p"))), t + 1
    edges = found[0]
    for x in found[1:]:
        edges = edges.union(x)
    return edges


def simhash_groups(docs: DataFrame, k: int = 5, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text): fingerprints link at ``bits`` or fewer differing bits."""
    with scratch_scope(docs.sparkSession) as keep:
        rows = settle(typed(docs, doc_id="long", text="string").mapInArrow(_prints(k), "doc_id long, fp long"))
        classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
        comp = components(links(classes.select("fp"), bits))
        of = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
        of = settle(of.select("fp", "doc_id", F.coalesce("component", "fp").alias("component")))
        least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = of.join(least, "component").select("fp", "component_id")
        out = rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
        return keep(out)


@query("op11_simhash")
def op11(spark, sf):
    return simhash_groups(read(spark, sf, "documents"), k=3, bits=3)
