"""Operator 10: benchmark decontamination by n-gram seeds and local alignment.

Words are lower-cased (A-Z) and lose ASCII punctuation at both ends. Every n-gram of every benchmark item is a seed. Where seeds of an item
lie near each other in a document they form a passage; its words travel on, the rest of the text does not. A score is
at most the number of words that passage and item share, each as often as the rarer side has it; passages in which this bound reaches the
least score are aligned to the item by Smith-Waterman on words (match 1, mismatch and gap -1), however many documents hold their seeds. A
document is contaminated if the best score reaches ``ratio`` of the item's words.

The index of the items goes to every task, in blocks of at most ``BLOCK_CHARS``; a larger benchmark takes several passes.

Defined cases: null or empty texts match nothing; items shorter than ``n`` words are one seed and must be found in full; repeated items are
reported under each item_id; rows of ``docs`` with one doc_id and text count once; a null doc_id is kept; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, query, read, scratch_scope, typed
from .kernels import LOWER, U64, chunks, shingles, spans_index, text_bytes, word_bounds, word_hashes

N = 4
RATIO = 0.5
#: Least score, so that a handful of common words is no copy; shorter items must be matched in full.
LEAST = 8
#: Benchmark text sent to tasks at once.
BLOCK_CHARS = 4 << 20
#: Longest passage in items' lengths; longer ones are cut with an overlap of three lengths.
LONGEST = 8
#: Contaminated documents up to which their ids are broadcast; beyond, the join shuffles.
FEW_IDS = 500_000

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text, one longer) of lower-cased words without punctuation at their ends."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets)
    while True:
        trim = np.flatnonzero((starts < ends) & _PUNCT[raw[np.minimum(starts, len(raw) - 1)]]) if len(raw) else np.zeros(0, np.int64)
        if not len(trim):
            break
        starts[trim] += 1
    while True:
        trim = np.flatnonzero((starts < ends) & _PUNCT[raw[ends - 1]]) if len(raw) else np.zeros(0, np.int64)
        if not len(trim):
            break
        ends[trim] -= 1
    full = starts < ends
    first = np.concatenate([[0], np.cumsum(full)])[first]
    return word_hashes(raw, starts[full], ends[full]), first


class ItemIndex:
    """Seeds of a block of items: sorted hashes with the items and places that hold them, by gram length."""

    def __init__(self, ids: list, texts: list[str], n: int = N):
        words, first = plain_words(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.vocabulary = [np.unique(w, return_counts=True) for w in self.words]
        lengths = np.diff(first)
        self.seeds = []
        for k in sorted({min(n, int(x)) for x in lengths if x}):
            mine = [i for i, x in enumerate(lengths) if x and min(n, x) == k]
            grams = [shingles(self.words[i], np.array([0, len(self.words[i])]), k)[0] for i in mine]
            hashes = np.concatenate(grams)
            item = np.repeat(mine, [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(hashes, kind="stable")
            self.seeds.append((k, hashes[order], item[order], place[order]))

    def shared(self, i: int, passage: np.ndarray) -> int:
        """Words that item ``i`` and the passage share, with multiplicity: no alignment scores more."""
        values, count = self.vocabulary[i]
        at = np.searchsorted(values, passage)
        at = at[values[np.minimum(at, len(values) - 1)] == passage]
        return int(np.minimum(np.bincount(at, minlength=len(values)), count).sum())

    def hits(self, words: np.ndarray, first: np.ndarray):
        """(text, word position, item, place in the item, seed hash) of every seed found."""
        found = []
        for k, hashes, item, place in self.seeds:
            if len(words) < k:
                continue
            grams, at = shingles(words, first, k)
            count = np.diff(at)
            short = np.repeat(np.diff(first) < k, count)
            lo = np.searchsorted(hashes, grams, "left")
            ok = np.flatnonzero((hashes[np.minimum(lo, len(hashes) - 1)] == grams) & ~short)
            lo = lo[ok]
            many = np.searchsorted(hashes, grams[ok], "right") - lo
            of = np.searchsorted(at, ok, "right") - 1
            rows = spans_index(lo, many)
            found.append((np.repeat(of, many), np.repeat(ok - at[of], many), item[rows], place[rows], hashes[rows]))
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else None


def enough(score, size, ratio: float):
    """Whether a score, or a bound on it, makes a copy of an item of ``size`` words."""
    return (score >= ratio * size) & (score >= np.minimum(LEAST, size))


def _passages(index: ItemIndex, ratio: float):
    length = np.array([len(w) for w in index.words])
    names = ["doc_id", "text_hash", "item", "begin", "words", "seeds"]

    def work(batches):
        for b in chunks(batches, "text"):
            words, first = plain_words(b.column("text"))
            hit = index.hits(words, first)
            if hit is None or not len(hit[0]):
                continue
            text, pos, item, place, seed = hit
            order = np.lexsort((pos, item, text))
            text, pos, item, place, seed = (x[order] for x in (text, pos, item, place, seed))
            new = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > 2 * length[item[1:]])
            head = np.flatnonzero(np.concatenate([[True], new]))
            tail = np.concatenate([head[1:], [len(text)]])
            rows, sequences, seeds = [], [], []
            for lo, hi in zip(head, tail, strict=True):
                d, i = int(text[lo]), int(item[lo])
                size, pad = int(length[i]), int(length[i]) // 2 + 1
                begin = max(0, int((pos[lo:hi] - place[lo:hi]).min()) - pad)
                end = min(int(first[d + 1] - first[d]), int((pos[lo:hi] - place[lo:hi]).max()) + size + pad)
                step = (LONGEST - 3) * size
                for at in range(begin, max(begin + 1, end - 3 * size), step):
                    stop = min(end, at + LONGEST * size)
                    inside = (pos[lo:hi] >= at) & (pos[lo:hi] < stop)
                    passage = words[first[d] + at : first[d] + stop]
                    if inside.any() and enough(index.shared(i, passage), size, ratio):
                        rows.append((d, i, at))
                        sequences.append(passage)
                        seeds.append(len(np.unique(seed[lo:hi][inside])))
            if not rows:
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sequences])]), pa.int32()), pa.array(np.concatenate(sequences).view(np.int64)))
            d = pa.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(d), b.column("text_hash").take(d), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), lists, pa.array(seeds, pa.int32())], names
            )

    return work


def best_local(item: list[np.ndarray], passage: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best score, end in the passage) of Smith-Waterman for each pair, all pairs at once, one row of the table per item word.

    A row's gaps along the passage are a running maximum: score at j of a gap from k is ``m[k] - (j - k)``.
    """
    rows, cols, n = max(map(len, item)), max(map(len, passage)), len(item)
    a, b = np.zeros((n, rows), U64), np.zeros((n, cols), U64)
    live, there = np.zeros((n, rows), bool), np.zeros((n, cols), bool)
    for i, (x, y) in enumerate(zip(item, passage, strict=True)):
        a[i, : len(x)], live[i, : len(x)] = x, True
        b[i, : len(y)], there[i, : len(y)] = y, True
    slope = np.arange(cols, dtype=np.int32)
    last = np.zeros((n, cols + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for r in range(rows):
        same = (a[:, r : r + 1] == b) & there & live[:, r : r + 1]
        row = np.maximum(last[:, :-1] + np.where(same, 1, -1), last[:, 1:] - 1)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row = np.maximum(row, 0)
        row = np.where(live[:, r : r + 1], row, last[:, 1:])
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
        last[:, 1:] = row
    return best, end


def _align(index: ItemIndex, ratio: float):
    names = ["doc_id", "text_hash", "item", "score", "first_word", "last_word", "seeds"]

    def score(pairs):
        items, passages = [index.words[p[2]] for p in pairs], [p[4] for p in pairs]
        best, end = best_local(items, passages)
        size = np.array([len(x) for x in items])
        ok = np.flatnonzero(enough(best, size, ratio))
        if not len(ok):
            return
        back, start = best_local([items[i][::-1] for i in ok], [passages[i][: end[i] + 1][::-1] for i in ok])
        for i, s in zip(ok, start, strict=True):
            doc, th, item, begin, _, seeds = pairs[i]
            yield doc, th, item, int(best[i]), int(begin + end[i] - s), int(begin + end[i]), seeds

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names)

    def work(batches):
        for b in batches:
            words = b.column("words")
            flat, off = words.flatten().to_numpy().view(U64), np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
            cols = [b.column(c).to_pylist() for c in ("doc_id", "text_hash", "item", "begin", "seeds")]
            pairs = [(d, t, i, g, flat[lo:hi], s) for d, t, i, g, lo, hi, s in zip(*cols[:4], off[:-1], off[1:], cols[4], strict=True)]
            pairs.sort(key=lambda p: len(p[4]))
            out, i = [], 0
            while i < len(pairs):
                j, cells = i, 0
                while j < len(pairs) and (j == i or cells + len(pairs[j][4]) <= 40_000):
                    cells += len(pairs[j][4])
                    j += 1
                out += score(pairs[i:j])
                i = j
            yield batch(out)

    return work


def _item_blocks(benchmark: DataFrame):
    """Lists of (item_id, text) of bounded size; the benchmark passes through the driver block by block."""
    ids, texts, held = [], [], 0
    for row in typed(benchmark, item_id="long", text="string").where(F.length("text") > 0).orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"])
        if held >= BLOCK_CHARS:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


_MATCH = "doc_id long, text_hash long, item_id long, score int, item_words int, first_word long, last_word long, seeds int"


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, ratio: float = RATIO) -> DataFrame:
    """One row per document and item that it holds a copy of: best score, words of the item, where in the document, number of seeds."""
    spark: SparkSession = docs.sparkSession
    rows = typed(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    out = None
    for ids, texts in _item_blocks(benchmark):
        index = ItemIndex(ids, texts, n)
        found = rows.mapInArrow(_passages(index, ratio), "doc_id long, text_hash long, item long, begin long, words array<long>, seeds int")
        # passages of an item that many documents hold are dealt over all tasks
        dealt = found.repartition("doc_id", "text_hash", "item", "begin")
        scored = dealt.mapInArrow(_align(index, ratio), "doc_id long, text_hash long, item long, score int, first_word long, last_word long, seeds int")
        best = scored.groupBy("doc_id", "text_hash", "item").agg(F.max(F.struct("score", (-F.col("first_word")).alias("at"), "last_word", "seeds")).alias("b"))
        items = spark.createDataFrame([(i, x, len(w)) for i, (x, w) in enumerate(zip(index.ids, index.words, strict=True))], "item long, item_id long, item_words int")
        part = best.join(F.broadcast(items), "item").select(
            "doc_id", "text_hash", "item_id", "b.score", "item_words", (-F.col("b.at")).alias("first_word"), "b.last_word", "b.seeds"
        )
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _MATCH) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a copy of an item; rows are told apart by doc_id and text, so clean ones stay."""
    with scratch_scope(docs.sparkSession) as keep:
        bad = keep(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_text")).distinct())
    side = F.broadcast(bad) if bad.count() <= FEW_IDS else bad
    key = fresh(docs, "text_hash")
    return docs.withColumn(key, F.xxhash64(F.col("text").cast("string"))).join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (F.col(key) == F.col("bad_text")), "left_anti").select(*docs.columns)


@query("op10_decontaminate")
def op10(spark, sf):
    found = contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "score", "item_words", "first_word", "last_word", "seeds")
