"""Operator 12: periodic runs of words from the enhanced suffix array, by the branching-tandem test.

A run is a stretch of words with smallest period q, of at least ``exponent`` periods and ``least`` words, that no neighbouring word extends.

1. The texts of a block are sequences of word ranks, each closed by a mark of its own. Prefix doubling over what is not yet told apart gives
   the suffix array, its inverse (ISA) and the rank of every 1, 2, 4 ... words, from which common prefixes (LCP) are read.
2. LCP intervals are found by the nearest boundaries that are at most as deep; no tree is built. For the suffixes ``i`` of all children of an
   interval but its largest, ``ISA[i + depth]`` and ``ISA[i - depth]`` inside the interval show a square of root ``depth``; it branches if the word
   behind it differs. Each suffix is in at most log2(n) such children.
3. A branching square is the last one of its run. The others are its rotations to the left: how far they go is read from the ranks. Squares of
   a multiple of the period meet in the same stretch, and the least period stays.

A run of at least ``exponent`` periods holds its root that often, so smaller intervals are left out. Texts are never cut; a block is about a
megabyte of whole texts, or one longer text. Words are compared by 64-bit hashes. Nothing is shuffled.

Defined cases: null and blank texts have no words and no runs, and collapse to the empty text; repeated rows and equal or null doc_ids are
rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, query, read, typed, word_count
from .kernels import U64, chunks, joined_words, spans_index, text_bytes, word_bounds, word_hashes

#: Bytes of text in a block.
BLOCK_BYTES = 1 << 20
#: Values below this are packed three to a 64-bit key for sorting.
PACKED = 1 << 21
#: Suffixes tested at once.
SLAB = 1 << 20
#: Jumps along nearest boundaries before the rest is found by range minima.
JUMPS = 12


def sorted_by(major: np.ndarray, minor: np.ndarray, at: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three arrays in the order of (major, minor, at); all values are under ``below``."""
    if below > PACKED:
        order = np.lexsort((at, minor, major))
        return major[order], minor[order], at[order]
    bits, low = U64(21), U64(PACKED - 1)
    key = np.sort((major.astype(U64) << U64(42)) | (minor.astype(U64) << bits) | at.astype(U64))
    return (key >> U64(42)).astype(np.int64), ((key >> bits) & low).astype(np.int64), (key & low).astype(np.int64)


def rank_levels(text: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4 ... words the rank of each position: how many suffixes are smaller in that many words. The last level tells all apart.

    ``text`` is the number of each position's text; word 0 ends it and stands there once.
    """
    n = len(words)
    below = int(max(n, words.max(initial=0) + 1))
    rank, levels, step = np.zeros(n, np.int64), [], 0
    group, ahead, at = sorted_by(text, words, np.arange(n), below)
    while True:
        count = len(at)
        of_group = np.concatenate([[True], group[1:] != group[:-1]])[:count]
        head = of_group.copy()
        head[1:] |= ahead[1:] != ahead[:-1]
        first = np.maximum.accumulate(np.where(head, np.arange(count), 0))
        if step:  # ranks inside the old class
            first_of = np.maximum.accumulate(np.where(of_group, np.arange(count), 0))
            rank = rank.copy()
            rank[at] = group + first - first_of
        else:
            rank[at] = first
        levels.append(rank)
        alone = head & np.concatenate([head[1:], [True]])[:count]
        at = at[~alone]
        if not len(at):
            return levels
        step = 2 * step or 1
        group, ahead, at = sorted_by(rank[at], rank[at + step], at, below)


def common_prefixes(levels: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """Words shared by each suffix with the one before it in order; 0 at both ends."""
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(sa) + 1, np.int64)
    shared, at = [], np.arange(len(a))
    for j, rank in enumerate(levels):
        at = at[rank[a[at]] == rank[b[at]]]
        lcp[at + 1] = 1 << j
        shared.append(at)
    for j in range(len(levels) - 2, -1, -1):
        at = shared[j + 1]
        k = lcp[at + 1]
        lcp[at + 1] = k + (levels[j][a[at] + k] == levels[j][b[at] + k]) * (1 << j)
    return lcp


def last_at_most(v: np.ndarray) -> np.ndarray:
    """For each positive value the nearest place before it with a value at most as large; ``v[0]`` is 0."""
    to = np.arange(len(v)) - 1
    open_ = np.flatnonzero(v > 0)
    open_ = open_[v[to[open_]] > v[open_]]
    for _ in range(JUMPS):
        if not len(open_):
            return to
        to[open_] = to[to[open_]]
        open_ = open_[v[to[open_]] > v[open_]]
    least = [v]
    while 2 << (len(least) - 1) <= len(v):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    place, most = to[open_], v[open_]
    for j in range(len(least) - 1, -1, -1):
        begin = place - (1 << j) + 1
        skip = (begin >= 0) & (least[j][np.maximum(begin, 0)] > most)
        place = np.where(skip, place - (1 << j), place)
    to[open_] = place
    return to


def branching_squares(words: np.ndarray, sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, exponent: int, least: int):
    """(start, root length) of branching squares whose root occurs often enough for a run."""
    n = len(sa)
    left = last_at_most(lcp)
    right = n - last_at_most(lcp[::-1])[::-1]
    deep = np.flatnonzero(lcp > 0)
    # boundaries of one interval are linked by equal depth; the first one stands for it
    lead = np.arange(n + 1)
    lead[deep] = np.where(lcp[left[deep]] < lcp[deep], deep, left[deep])
    while True:
        further = lead[lead]
        if (further == lead).all():
            break
        lead = further
    end = np.zeros(n + 1, np.int64)
    np.maximum.at(end, lead[deep], right[deep])
    big = end[lead[deep]] - left[lead[deep]] >= np.maximum(exponent, least // lcp[deep])
    deep = deep[big]
    heads = deep[lead[deep] == deep]
    # children: the one to the right of each boundary, and the first one of each interval
    begin, size, of = np.concatenate([deep, left[heads]]), np.concatenate([right[deep] - deep, heads - left[heads]]), np.concatenate([lead[deep], heads])
    name = size * (n + 1) + np.concatenate([deep, np.zeros(len(heads), np.int64)])
    largest = np.zeros(n + 1, np.int64)
    np.maximum.at(largest, of, name)
    small = name != largest[of]
    begin, size, of = begin[small], size[small], of[small]
    total = np.cumsum(size)
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLAB, "right")))
        i = sa[spans_index(begin[lo:hi], size[lo:hi])]
        o = np.repeat(of[lo:hi], size[lo:hi])
        depth, first, last = lcp[o], left[o], end[o]
        for sign in (1, -1):
            j = i + sign * depth
            ok = np.flatnonzero((j >= 0) & (j < n))
            place = isa[j[ok]]
            ok = ok[(place >= first[ok]) & (place < last[ok])]
            at, d = np.minimum(i[ok], j[ok]), depth[ok]
            ends = words[at + d] != words[at + 2 * d]
            yield at[ends], d[ends]
        lo = hi


def runs(words: np.ndarray, ends: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) in order of start, then period, for texts laid end to end: text t ends before ``ends[t]``, words are numbers from 1.

    Places count the end mark behind each text: they are those of the sequence with marks.
    """
    size = np.diff(np.concatenate([[0], ends])) + 1
    text = np.repeat(np.arange(len(size)), size)
    marked = np.zeros(len(text), np.int64)
    marked[np.arange(len(words)) + np.repeat(np.arange(len(size)), size - 1)] = words
    levels = rank_levels(text, marked)
    isa = levels[-1]
    sa = np.empty(len(isa), np.int64)
    sa[isa] = np.arange(len(isa))
    found = list(branching_squares(marked, sa, isa, common_prefixes(levels, sa), exponent, least))
    at, d = (np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)]) for c in (0, 1))
    s = at.copy()
    for j in range(len(levels) - 1, -1, -1):
        before = s - (1 << j)
        ok = np.maximum(before, 0)
        s = np.where((before >= 0) & (levels[j][ok] == levels[j][ok + d]), before, s)
    e = at + 2 * d
    long = e - s >= np.maximum(least, exponent * d)
    s, e, d = s[long], e[long], d[long]
    order = np.lexsort((d, e, s))
    s, e, d = s[order], e[order], d[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])[: len(s)]
    s, e, d = s[new], e[new], d[new]
    order = np.lexsort((d, s))
    return s[order], e[order], d[order]


def _work(exponent: int, least: int):
    def work(batches):
        for b in chunks(batches, "text", BLOCK_BYTES):
            raw, offsets = text_bytes(b.column("text"))
            starts, ends, first = word_bounds(raw, offsets)
            number = np.unique(word_hashes(raw, starts, ends), return_inverse=True)[1] + 1
            s, e, d = runs(number, first[1:], exponent, least)
            text = np.searchsorted(first[1:] + np.arange(1, len(first)), s, "right")
            drop = np.zeros(len(starts) + 1, np.int64)
            np.add.at(drop, s + d - text, 1)
            np.add.at(drop, e - text, -1)
            stay = np.cumsum(drop)[:-1] == 0
            buf, begin = joined_words(raw, starts[stay], ends[stay])
            upto = np.concatenate([[0], np.cumsum(stay)])[first]
            begin, buf = np.concatenate([begin, [len(buf)]]), buf.tobytes()
            kept = [buf[begin[x] : max(begin[x], begin[y] - 1)] for x, y in zip(upto[:-1], upto[1:], strict=True)]
            cut = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b.num_rows))])
            fields = [pa.array(x) for x in (s - text - first[text], e - s, d)]
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return work


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs`` (doc_id, text).

    ``runs``: all runs (start, length, period) in order of start, then period. ``collapsed``: the words, joined by one space, without those
    that a run holds after its first period.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    kinds = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return typed(docs, doc_id="long", text="string").mapInArrow(_work(exponent, least), kinds)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which one text in ten, chosen by its doc_id's checksum, ends in a repeated stretch of its words; a null doc_id is left alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), word_count("text")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    repeated = F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(tail)), F.lit(1), n.cast("int"))
    planted = F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))
    return typed(docs, doc_id="long", text="string").select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


@query("op12_periodic_runs")
def op12(spark, sf):
    found = periodic_runs(with_planted_periods(read(spark, sf, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), _sha(lines).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
