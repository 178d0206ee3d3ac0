"""Operator 1: removal of repeated substrings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every byte goes that lies in a string of ``length`` bytes which also starts anywhere else, in the same text or another.

1. Winnowing (grams of ``GRAM`` bytes, one window per string of ``length`` bytes) gives every such string one seed: equal strings have equal
   seeds at equal offsets. Runs of starts with one seed are kept per distinct text.
2. Runs whose seed is found elsewhere too become pieces: their bytes and ``length - 1`` more. Equal pieces are counted once, with their number.
3. Pieces of one seed meet in one task. Keys with many pieces are cut by the offset of the seed in narrowing blocks, and keyed by the bytes
   that all strings of a block share, down to single strings, of which equal ones are one piece. So no group grows with the corpus. Cuts that a
   task holds twice are shared: they go on as one, and only those it holds once are joined with what is found below.
4. A task builds the Burrows-Wheeler transform of its pieces and expands intervals breadth first by backward extension: a boundary between
   neighbours in suffix order is met when the strings on its two sides part, which gives common prefixes by increasing value. The
   expansion ends at ``length``; starts whose boundary is then still unmet share ``length`` bytes with their neighbour.

Only seeds, pieces and spans are shuffled. Texts are read three times: for seeds, for the pieces of texts that have some, for what is kept.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; a text that occurs twice loses everything if it is long enough;
equal doc_ids are told apart by their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, query, read, settle, typed
from .kernels import U64, chunks, rolling, spans_index, windows_min

GRAM = 64
#: Starts in one piece at most.
RUN = 16_384
#: A key with more pieces or bytes than this is cut further; what stays fits one transform.
HOT_PIECES, HOT_BYTES = 4_096, 1_900_000
WIDTHS = (48, 12, 3, 1)
#: Cuts among which a task looks for equal ones, and the bytes of the different ones.
SLICE, SLICE_BYTES = 16_000, 8 << 20
#: Bytes for one transform: positions and ranks take 21 bits each.
BLOCK = (1 << 21) - 1
BUCKET_BYTES = 1_200_000
#: Rows up to which a table of texts with pieces or spans is broadcast; beyond, the join shuffles.
FEW_TEXTS, FEW_RUNS = 200_000, 2_000_000


def selections(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a string of ``length`` bytes: its seed's hash (top 32 bits of the gram's) and the seed's position."""
    h = rolling(raw, GRAM)
    order = (h & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(len(h), dtype=U64))
    least = windows_min(order, length - GRAM + 1)
    at = (U64(0xFFFFFFFF) - (least & U64(0xFFFFFFFF))).astype(np.int64)
    return h[at], at


def _runs(changed: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts) of the runs between changes, cut at ``longest``."""
    first = np.flatnonzero(np.concatenate([[True], changed]))
    count = np.diff(np.concatenate([first, [len(changed) + 1]]))
    if count.max() <= longest:
        return first, count
    many = -(-count // longest)
    nth = spans_index(np.zeros(len(many), np.int64), many)
    start = np.repeat(first, many) + nth * longest
    return start, np.minimum(longest, np.repeat(first + count, many) - start)


def _seeds(length: int):
    """One row per text: digest, length and its runs (seed, first start, number of starts, 1 if the seed is there twice)."""

    def work(batches):
        for b in chunks(batches, "text"):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            sha, size, seeds, lows, counts, twice, ends = [], [], [], [], [], [], [0]
            for t in texts:
                t = t or b""
                sha.append(hashlib.sha256(t).digest())
                size.append(len(t))
                if len(t) >= length:
                    h, at = selections(np.frombuffer(t, np.uint8), length)
                    lo, n = _runs(h[1:] != h[:-1], RUN)
                    seeds.append(h[lo].view(np.int64))
                    lows.append(lo)
                    counts.append(n)
                    twice.append((at[lo + n - 1] != at[lo]).astype(np.int64))
                ends.append(ends[-1] + (len(seeds[-1]) if len(t) >= length else 0))
            off = pa.array(ends, pa.int32())
            flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sha, pa.binary()), pa.array(size, pa.int64()), *(pa.ListArray.from_arrays(off, pa.array(flat(x))) for x in (seeds, lows, counts, twice))],
                ["doc_id", "sha", "n_bytes", "seed", "lo", "n", "twice"],
            )

    return work


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\x00".join(parts), digest_size=16).digest()


def _cut(piece: bytes, length: int, width: int):
    """Pieces of single seed offsets' blocks: (key, first start, number of starts); blocks are aligned to the seed, so equal strings get equal keys."""
    raw = np.frombuffer(piece, np.uint8)
    h, at = selections(raw, length)
    block = (at - np.arange(len(at))) // width
    lo, n = _runs((at[1:] != at[:-1]) | (block[1:] != block[:-1]), RUN)
    for s, c in zip(lo, n, strict=True):
        core = int(at[s] - block[s] * width)
        yield _digest(h[s].tobytes(), width.to_bytes(2, "big"), int(block[s]).to_bytes(4, "big"), piece[core : core - width + 1 + length]), int(s), int(c)


#: What ``_cuts`` makes.
CUTS = "pid binary, key binary, seg binary, mult long, parent binary, at long, a array<long>, b array<long>"


def _cuts(found, bare: bool = False):
    """Equal cuts of a slice as one row (pid, key, seg, mult) from (key, bytes, mult, parent, first start, number of starts); ``bare``: without the bytes.

    A cut that is there once names its ``parent`` and its start ``at`` there. What is there twice is shared, whatever other tasks hold: its parents
    get these starts at once, as runs (parent, a, b) in a row of their own without pid.
    """
    held, size, room = {}, 0, 0
    for key, part, mult, parent, lo, n in found:
        cut = held.setdefault(_digest(key, part), [key, None if bare else part, 0, []])
        room += len(part) if not cut[3] else 0
        cut[2] += mult
        cut[3].append((parent, lo, lo + n))
        size += 1
        if size > SLICE or room > SLICE_BYTES:
            yield _rows(held)
            held, size, room = {}, 0, 0
    yield _rows(held)


def _rows(held: dict) -> pa.RecordBatch:
    rows, known = [], {}
    for pid, (key, part, mult, places) in held.items():
        if mult == 1:
            rows.append((pid, key, part, mult, *places[0][:2], None, None))
            continue
        rows.append((pid, key, part, mult, None, None, None, None))
        for parent, lo, hi in places:
            known.setdefault(parent, []).append((lo, hi))
    for parent, runs in known.items():
        lows, highs = (np.sort(np.array(x, np.int64)) for x in zip(*runs, strict=True))
        apart = np.flatnonzero(lows[1:] > highs[:-1])
        rows.append((None, None, None, None, parent, None, lows[np.concatenate([[0], apart + 1])], highs[np.concatenate([apart, [-1]])]))
    cols = list(zip(*rows, strict=True)) or [[]] * 8
    kinds = (pa.binary(),) * 3 + (pa.int64(), pa.binary(), pa.int64()) + (pa.list_(pa.int64()),) * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["pid", "key", "seg", "mult", "parent", "at", "a", "b"])


def _extract(length: int):
    """Pieces of the wanted runs of each text that is the text meant; their parents are the texts."""

    def pieces(batches):
        for b in chunks(batches, "text"):
            for sha, text, seeds, lows, counts in zip(*(b.column(c).to_pylist() for c in ("sha", "text", "seed", "lo", "n")), strict=True):
                raw = text.encode()
                if hashlib.sha256(raw).digest() != sha:
                    continue
                for s, lo, n in zip(seeds, lows, counts, strict=True):
                    yield s.to_bytes(8, "big", signed=True), raw[lo : lo + n + length - 1], 1, sha, lo, n

    return lambda batches: _cuts(pieces(batches))


def _recut(length: int, width: int):
    """Children of pieces; single strings go without their bytes."""

    def children(batches):
        for b in batches:
            pids, keys, segs, mults = (b.column(c).to_pylist() for c in ("pid", "key", "seg", "mult"))
            for i in sorted(range(len(keys)), key=keys.__getitem__):
                for key, lo, n in _cut(segs[i], length, width):
                    yield key, segs[i][lo : lo + n + length - 1], mults[i], pids[i], lo, n

    return lambda batches: _cuts(children(batches), bare=width == 1)


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the first ``depth`` codes behind them (codes below 512, fewer than 2**21 of them), by prefix doubling."""
    n = len(codes)
    index, bits = np.arange(n, dtype=U64), U64(21)
    mask = U64((1 << 21) - 1)

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        packed = np.sort((key << bits) | index)
        order = (packed & mask).astype(np.int64)
        new = (packed[1:] >> bits) != (packed[:-1] >> bits)
        rank = np.empty(n, U64)
        rank[order] = np.concatenate([[0], np.cumsum(new)]).astype(U64)
        return rank, order, bool(new.all())

    padded = np.concatenate([codes.astype(U64), np.zeros(4, U64)])
    key = np.zeros(n, U64)
    for j in range(4):
        key = (key << U64(9)) | padded[j : j + n]
    rank, order, done = ranked(key)
    have = 4
    while have < depth and not done:
        step = min(have, depth - have)  # the last step overlaps, so that it ends at depth exactly
        ahead = np.zeros(n, U64)
        ahead[: max(0, n - step)] = rank[step:]
        rank, order, done = ranked((rank << bits) | ahead)
        have += step
    return order


def shared_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the starts whose ``length`` bytes also start elsewhere in these pieces.

    Interval expansion on the transform of all pieces, each ended by code 0, which is never put in front of a string.
    """
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    raw = np.frombuffer(b"\x00".join(pieces) + b"\x00", np.uint8)
    codes = raw.astype(np.int16) + 1
    codes[ends - 1] = 0
    n = len(codes)
    order = suffix_order(codes, length)
    bwt = codes[order - 1]
    by_code = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_code] = np.arange(n)
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    edges = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=257))])
    lo, hi = edges[:-1], edges[1:]
    fresh = (hi > lo) & ~met[hi]
    met[hi[hi > lo]] = True
    lo, hi = lo[fresh], hi[fresh]
    for _ in range(length - 1):  # strings of 2, 3, ... length bytes
        if not len(lo):
            break
        size = hi - lo
        alone = size == 1
        one = lo[alone]
        one = lf[one[bwt[one] > 0]]
        wide_lo, wide = lo[~alone], size[~alone]
        at = spans_index(wide_lo, wide)
        real = bwt[at] > 0
        packed = np.sort((np.repeat(np.arange(len(wide)), wide)[real] << 21) | lf[at[real]])
        # rows of one interval and one code in front are neighbours, and so are their targets
        target, owner = packed & ((1 << 21) - 1), packed >> 21
        front = codes[order[target]]
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (front[1:] != front[:-1])])) if len(packed) else np.zeros(0, np.int64)
        tail = np.concatenate([head[1:], [len(packed)]]) - 1 if len(head) else head
        lo = np.concatenate([one, target[head]])
        hi = np.concatenate([one, target[tail]]) + 1
        fresh = ~met[hi]
        lo, hi = lo[fresh], hi[fresh]
        met[hi] = True
    # a rank shares ``length`` bytes with the rank before it if their boundary was never met
    joined = ~met[:n]
    joined[:-1] |= ~met[1:n]
    flags = np.zeros(n, bool)
    flags[order[joined]] = True
    begin = ends - sizes - 1
    return [np.flatnonzero(flags[b : b + max(0, s - length + 1)]) for b, s in zip(begin, sizes, strict=True)]


def _solve(length: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of shared starts of each piece of a bucket; keys stay whole, and a transform takes as many as fit."""
        pdf = pdf.sort_values(["key", "pid"])
        keys, segs, mults, pids = (pdf[c].tolist() for c in ("key", "seg", "mult", "pid"))
        out = []

        def flush(rows):
            alone = len(rows) == 1 and len(segs[rows[0]]) <= length
            found = [np.zeros(0, np.int64)] if alone else shared_starts([segs[i] for i in rows], length)
            for i, starts in zip(rows, found, strict=True):
                if mults[i] > 1:
                    out.append((pids[i], [0], [len(segs[i]) - length + 1]))
                elif len(starts):
                    cut = np.flatnonzero(np.diff(starts) > 1)
                    out.append((pids[i], starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [-1]])] + 1))

        held, size, i = [], 0, 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            group = sum(len(segs[x]) + 1 for x in range(i, j))
            if held and size + group > BLOCK:
                flush(held)
                held, size = [], 0
            held += range(i, j)
            size += group
            i = j
        if held:
            flush(held)
        return pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(("pid", "a", "b"))})

    return work


def _merged(batches):
    """Runs of each piece in order, touching ones joined."""
    for b in batches:
        lows, highs = [], []
        for a, z in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            a, z = np.sort(np.array(a, np.int64)), np.sort(np.array(z, np.int64))
            # a gap lies where the next start is behind the ends of as many runs as began before it
            apart = np.flatnonzero(a[1:] > np.maximum.accumulate(z)[:-1])
            lows.append(a[np.concatenate([[0], apart + 1])])
            highs.append(z[np.concatenate([apart, [len(z) - 1]])])
        yield pa.RecordBatch.from_arrays([b.column("pid"), pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))], ["pid", "a", "b"])


def _distinct(cuts: DataFrame) -> DataFrame:
    return settle(cuts.where("pid is not null").groupBy("pid").agg(F.first("key").alias("key"), F.first("seg").alias("seg"), F.sum("mult").alias("mult")))


def _lifted(cuts: DataFrame, shared: DataFrame) -> DataFrame:
    """(parent, a, b): runs of shared starts of the parents of ``cuts``; only cuts that were single in their task meet ``shared`` (pid, a, b)."""
    moved = lambda c: F.transform(c, lambda x: x + F.col("at")).alias(c)
    linked = cuts.where("pid is not null and parent is not null").select("pid", "parent", "at").join(shared, "pid").select("parent", moved("a"), moved("b"))
    return linked.unionByName(cuts.where("pid is null").select("parent", "a", "b"))


def _shared(pieces: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(pid, a, b): runs of shared starts of distinct ``pieces`` (pid, key, seg, mult). Large keys go through narrower blocks."""
    spark = pieces.sparkSession
    if level == len(WIDTHS):  # single strings, of which equal ones are one piece
        once = lambda i: F.array(F.lit(i).cast("long"))
        return pieces.where("mult > 1").select("pid", once(0).alias("a"), once(1).alias("b"))
    sizes = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("seg")).alias("held"))
    too_many = (F.col("m") > HOT_PIECES) | ((F.col("held") > HOT_BYTES) & (F.col("m") > 1))
    hot = settle(sizes.where(too_many).select("key"))
    n_hot = hot.count()
    cold = pieces.join(F.broadcast(hot) if n_hot <= FEW_TEXTS else hot, "key", "left_anti") if n_hot else pieces
    total = cold.agg(F.sum(F.length("seg"))).first()[0] or 0
    buckets = parts_for(spark, total, BUCKET_BYTES)
    solved = cold.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(_solve(length), "pid binary, a array<long>, b array<long>")
    if not n_hot:
        return solved
    warm = pieces.join(F.broadcast(hot) if n_hot <= FEW_TEXTS else hot, "key", "left_semi")
    children = settle(warm.mapInArrow(_recut(length, WIDTHS[level]), CUTS))
    runs = _lifted(children, _shared(_distinct(children), length, level + 1)).groupBy(F.col("parent").alias("pid"))
    lifted = runs.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in "ab")).mapInArrow(_merged, "pid binary, a array<long>, b array<long>")
    return settle(solved.unionByName(lifted))


def _kept(length: int):
    """Digest row of each text given its runs of shared starts."""

    def work(batches):
        for b in chunks(batches, "text"):
            out = []
            for doc, sha, text, lows, highs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "sha", "text", "a", "b")), strict=True):
                raw = (text or "").encode()
                if hashlib.sha256(raw).digest() != sha:
                    continue
                gone = np.zeros(len(raw) + 1, np.int64)
                np.add.at(gone, np.array(lows), 1)
                np.add.at(gone, np.array(highs) + length - 1, -1)
                removed = np.cumsum(gone)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~removed].tobytes()
                spans = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum())
                out.append((doc, len(raw), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return work


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs`` (doc_id, text); ``with_text`` adds the kept bytes.

    The kept bytes may cut a character, hence binary.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    docs = typed(docs, doc_id="long", text="string")
    rows = settle(docs.mapInArrow(_seeds(length), "doc_id long, sha binary, n_bytes long, seed array<long>, lo array<long>, n array<long>, twice array<long>"))
    texts = settle(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("seed").alias("seed"), F.first("lo").alias("lo"), F.first("n").alias("n"), F.first("twice").alias("twice")))
    runs = texts.select("sha", "doc_id", F.explode(F.arrays_zip("seed", "lo", "n", "twice")).alias("r")).select("sha", "doc_id", "r.*")
    # a seed matters if two runs have it, or one run at two positions
    seen = runs.groupBy("seed").agg((F.count(F.lit(1)) + F.max("twice")).alias("m")).where("m > 1").select("seed")
    per_text = settle(
        runs.join(seen, "seed").groupBy("sha").agg(F.first("doc_id").alias("wanted"), F.collect_list(F.struct("seed", "lo", "n")).alias("r"))
        .select("sha", "wanted", F.col("r.seed").alias("seed"), F.col("r.lo").alias("lo"), F.col("r.n").alias("n"))
    )
    few = per_text.agg(F.count(F.lit(1)).alias("t"), F.sum(F.size("seed")).alias("r")).first()
    side = F.broadcast(per_text) if few["t"] <= FEW_TEXTS and (few["r"] or 0) <= FEW_RUNS else per_text
    held = docs.join(side, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("sha", "text", "seed", "lo", "n")
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        held = held.dropDuplicates(["sha", "text"])  # a text that stands twice under one doc_id is no second place
    pieces = settle(held.mapInArrow(_extract(length), CUTS))
    found = _lifted(pieces, _shared(_distinct(pieces), length)).withColumnRenamed("parent", "sha")
    single = texts.where("copies = 1").select("sha", "doc_id")
    spans = settle(
        found.join(single, "sha").groupBy("sha").agg(F.first("doc_id").alias("wanted"), *(F.flatten(F.collect_list(c)).alias(c) for c in "ab"))
        .select("sha", "wanted", "a", "b")
    )
    few = spans.agg(F.count(F.lit(1)).alias("t"), F.sum(F.size("a")).alias("r")).first()
    small = few["t"] <= FEW_TEXTS and (few["r"] or 0) <= FEW_RUNS
    cut = docs.join(F.broadcast(spans) if small else spans, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("doc_id", "sha", "text", "a", "b")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    changed = cut.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").select(*names)
    touched = spans.select("sha")
    rest = rows.select("doc_id", "sha", "n_bytes").join(F.broadcast(touched) if small else touched, "sha", "left_anti")
    twice = texts.where("copies > 1").select(F.col("sha").alias("twice"))
    rest = rest.join(F.broadcast(twice) if twice.count() <= FEW_TEXTS else twice, F.col("sha") == F.col("twice"), "left")
    gone = F.col("twice").isNotNull() & (F.col("n_bytes") >= length)
    whole = rest.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"), *([F.col("sha")] * with_text),
    )
    if with_text:
        texts_of = docs.select("doc_id", F.sha2("text", 256).alias("of"), F.col("text").cast("binary").alias("kept")).dropDuplicates(["doc_id", "of"])
        whole = whole.join(texts_of, whole["doc_id"].eqNullSafe(texts_of["doc_id"]) & (F.lower(F.hex("sha")) == F.col("of")), "left").select(
            whole["doc_id"], "n_bytes", "n_removed", "n_spans", "kept_sha256", F.when(F.col("n_removed") > 0, F.lit(b"")).otherwise(F.coalesce("kept", F.lit(b""))).alias("kept")
        )
    return changed.unionByName(whole)


@query("op1_suffix_dedup")
def op1(spark, sf):
    return remove_repeats(read(spark, sf, "documents")).withColumn("shortened", F.col("n_removed") > 0)
