"""Operator 9: exact word-shingle Jaccard self-join and its connected components, with signature trees.

1. Word frequencies are summed into a fixed table of 65,536 counters. A shingle's place in the global order is the sum of its words' log
   frequencies, then its hash: shingles with rare words come first, and a passage that many documents share comes last.
2. Each document keeps its set size, a 128-bit fingerprint of its set, a token bitmap of two to four bits an item (at least 1,024) and its prefix: the first
   ``n - ceil(t * n) + 1`` shingles in that order. Sets that link share a prefix shingle. Equal sets form one class from here on, and of
   prefix shingles that the same classes have one is kept.
3. The classes of all prefix shingles whose most shared class is the same make one star, so that a bitmap moves once for all of them. Stars whose
   classes still lie in several components get a signature tree: nodes hold OR-combined bitmaps, size ranges and component ranges. A dual
   traversal drops node pairs of one component, of incompatible sizes or with too small a possible overlap; leaf pairs are bounded again by their
   whole bitmaps. A star with more than ``CELL`` classes is cut by size, then into chunks whose pairs meet in tasks of their own.
4. Traversals go in rounds. In each a component of a star offers its ``offer`` most promising pairs, which are checked exactly by whole sets; the
   links found join components. A component that held pairs back goes into the next round, which offers more; the last has no bound. So no
   link between different components is missed, and a large group of near copies is joined by a few pairs a member.

Defined cases: null and empty texts, and texts of white space, have an empty set and are their own component; a null doc_id never names a
component of others, but links through it count; repeated rows are equal sets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, parts_for, query, read, release, scratch_scope, settle, typed
from .components import components
from .kernels import LOWER, U64, chunks, distinct, mix, shingles, text_bytes, word_bounds, word_hashes

#: Counters of the word-frequency table: 512 KB, whatever the input.
COUNTERS = 1 << 16
#: Bits of a tree node; documents have bitmaps of at least as many.
BITS = 1024
WIDEST = 1 << 19
#: Classes of one star that one task compares; more are cut into chunks.
CELL = 4096
FAN = 8
#: Pairs that a component of a star offers in each round; the last round has no bound.
OFFERS = (4, 64, None)
#: Pairs that a traversal holds before it drops those beyond the offer.
HELD = 500_000
#: Node pairs that a traversal holds at once.
SLAB = 200_000
#: Ids up to which a list of documents is broadcast (about 16 MB); beyond, the join shuffles.
FEW_IDS = 500_000
FEW_TOKENS = 2_000_000


def word_levels(docs: DataFrame) -> np.ndarray:
    """Per counter the rounded log2 of its share over the mean, 0 to 15, from all words of all documents."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in chunks(batches, "text"):
            raw, offsets = text_bytes(b.column("text"))
            raw = LOWER[raw]
            starts, ends, _ = word_bounds(raw, offsets)
            total += np.bincount((word_hashes(raw, starts, ends) >> U64(48)).astype(np.int64), minlength=COUNTERS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["counter", "n"])

    rows = docs.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    levels = np.zeros(COUNTERS, np.uint8)
    found = rows.toPandas()  # one row per counter at most
    if len(found):
        mean = max(found["n"].sum() / COUNTERS, 1.0)
        levels[found["counter"].to_numpy()] = np.clip(np.round(np.log2(np.maximum(found["n"].to_numpy() / mean, 1.0))), 0, 15).astype(np.uint8)
    return levels


def _keyed(batch: pa.RecordBatch, levels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(order keys, offsets by document): rarity of the words in the top byte, the shingle's hash below."""
    raw, offsets = text_bytes(batch.column("text"))
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends)
    hashed, at = shingles(words, first, k)
    running = np.concatenate([[0], np.cumsum(levels[(words >> U64(48)).astype(np.int64)].astype(np.int64))])
    count = np.diff(at)
    begin = np.arange(len(hashed)) - np.repeat(at[:-1], count) + np.repeat(first[:-1], count)
    width = np.minimum(np.repeat(np.diff(first), count), k)
    rarity = np.minimum(running[begin + width] - running[begin], 127).astype(U64)
    return (rarity << U64(56)) | (hashed >> U64(8)), at


def _unique(keys: np.ndarray, at: np.ndarray):
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield distinct(keys[lo:hi])


def fingerprint(s: np.ndarray) -> bytes:
    both = np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) + U64(len(s))], U64)
    return mix(both).tobytes()


def bitmap(s: np.ndarray) -> bytes:
    """One bit per item by its low bits; the width is a power of two of at least two bits an item, so wider ones fold onto narrower."""
    width = min(max(BITS, 1 << (2 * max(len(s), 1) - 1).bit_length()), WIDEST)
    flags = np.zeros(width, bool)
    flags[(s & U64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size // 8), axis=0)


def _profile(levels: np.ndarray, k: int, num: int, den: int):
    def work(batches):
        for b in chunks(batches, "text"):
            keys, at = _keyed(b, levels, k)
            n, prints, prefix, bits = [], [], [], []
            for s in _unique(keys, at):
                n.append(len(s))
                prints.append(fingerprint(s))
                prefix.append(s[: len(s) - -(-num * len(s) // den) + 1].astype(np.int64) if len(s) else np.zeros(0, np.int64))
                bits.append(bitmap(s))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32()), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), lists, pa.array(bits, pa.binary())],
                ["doc_id", "digest", "n", "fp", "prefix", "bits"],
            )

    return work


def _sets(levels: np.ndarray, k: int):
    def work(batches):
        for b in chunks(batches, "text"):
            keys, at = _keyed(b, levels, k)
            found = list(_unique(keys, at))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]), pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, U64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in found], pa.binary()), lists], ["fp", "items"])

    return work


def _popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


class Bitmaps:
    """Bitmaps of different widths, side by side; a pair is compared at the narrower width of the two. Linked sizes differ ``reach``-fold at most."""

    def __init__(self, bits: list[bytes], size: np.ndarray, reach: float):
        self.bits, self.size, self.width = bits, size, np.array([len(b) for b in bits], np.int64)
        self.steps = 2 ** int(np.ceil(np.log2(reach)))
        self.at: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _folded(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each row, bitmaps, items that share a bit) of the rows that are as wide, or as much wider as linked ones can be."""
        if width not in self.at:
            rows = np.flatnonzero((self.width >= width) & (self.width <= self.steps * width))
            place = np.full(len(self.bits), -1, np.int64)
            place[rows] = np.arange(len(rows))
            held = np.stack([folded(self.bits[i], width) for i in rows])
            self.at[width] = place, held, self.size[rows] - _popcount(held)
        return self.at[width]

    def overlap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Largest overlap of pairs of rows that their bitmaps allow."""
        most = np.zeros(len(x), np.int64)
        narrow = np.minimum(self.width[x], self.width[y])
        for w in np.unique(narrow).tolist():
            rows = np.flatnonzero(narrow == w)
            place, held, spare = self._folded(w)
            step = max(1, (8 << 20) // w)
            for i in range(0, len(rows), step):
                at = rows[i : i + step]
                u, v = place[x[at]], place[y[at]]
                far = (u < 0) | (v < 0)  # sizes too unlike to link
                most[at] = np.where(far, 0, possible(held[u], held[v], spare[u], spare[v], self.size[x[at]], self.size[y[at]]))
        return most


def possible(bits_x, bits_y, spare_x, spare_y, max_x, max_y):
    """Largest overlap that two nodes allow: shared bits, plus the items that share a bit in either, at most the smaller size."""
    return np.minimum(np.minimum(max_x, max_y), _popcount(bits_x & bits_y) + np.minimum(spare_x, spare_y))


class SignatureTree:
    """Leaves in (cell, size) order; ``FAN`` neighbours of one cell share a parent, up to one root per cell."""

    def __init__(self, cell: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        spare = size - _popcount(bits)
        self.levels = [dict(cell=cell, lo=size, hi=size, c_lo=comp, c_hi=comp, spare=spare, bits=bits, first=np.arange(len(cell)), count=np.ones(len(cell), np.int64))]
        while True:
            low = self.levels[-1]
            start = np.flatnonzero(np.concatenate([[True], low["cell"][1:] != low["cell"][:-1]])) if len(low["cell"]) else np.zeros(0, np.int64)
            if len(start) == len(low["cell"]):
                break
            rank = np.arange(len(low["cell"])) - np.repeat(start, np.diff(np.concatenate([start, [len(low["cell"])]])))
            heads = np.flatnonzero(rank % FAN == 0)
            self.levels.append(
                dict(
                    cell=low["cell"][heads], lo=np.minimum.reduceat(low["lo"], heads), hi=np.maximum.reduceat(low["hi"], heads),
                    c_lo=np.minimum.reduceat(low["c_lo"], heads), c_hi=np.maximum.reduceat(low["c_hi"], heads), spare=np.maximum.reduceat(low["spare"], heads),
                    bits=np.bitwise_or.reduceat(low["bits"], heads, axis=0), first=heads, count=np.diff(np.concatenate([heads, [len(low["cell"])]])),
                )
            )

    def keep(self, level: int, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
        t = self.levels[level]
        one = (t["c_lo"][x] == t["c_hi"][x]) & (t["c_lo"][y] == t["c_hi"][y]) & (t["c_lo"][x] == t["c_lo"][y])
        fits = (t["hi"][x] * den >= num * t["lo"][y]) & (t["hi"][y] * den >= num * t["lo"][x])
        ok = ~one & fits
        at = np.flatnonzero(ok)
        x, y = x[at], y[at]
        most = possible(t["bits"][x], t["bits"][y], t["spare"][x], t["spare"][y], t["hi"][x], t["hi"][y])
        ok[at] = (num + den) * most >= num * (t["lo"][x] + t["lo"][y])
        return ok

    def pairs(self, num: int, den: int):
        """Leaf pairs that the bounds cannot exclude, in arrays."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["cell"]))
        stack = [(top, roots[i : i + SLAB], roots[i : i + SLAB]) for i in range(0, len(roots), SLAB)]
        while stack:
            level, x, y = stack.pop()
            ok = self.keep(level, x, y, num, den)
            x, y = x[ok], y[ok]
            if level == 0:
                apart = x != y
                yield x[apart], y[apart]
                continue
            t = self.levels[level]
            cx, cy = t["count"][x], t["count"][y]
            each = cx * cy
            step = max(1, SLAB // (FAN * FAN))
            for i in range(0, len(x), step):
                s = slice(i, i + step)
                nth = np.arange(int(each[s].sum())) - np.repeat(np.cumsum(each[s]) - each[s], each[s])
                wide = np.repeat(cy[s], each[s])
                a, b = np.repeat(t["first"][x[s]], each[s]) + nth // wide, np.repeat(t["first"][y[s]], each[s]) + nth % wide
                ordered = a <= b
                stack.append((level - 1, a[ordered], b[ordered]))


class Offers:
    """The most promising pairs of each component: pairs beyond the offer of both their components are held back."""

    def __init__(self, comp: np.ndarray, offer: int | None):
        self.comp, self.offer = comp, offer
        self.x = self.y = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.cut = np.zeros(len(comp), bool)

    def add(self, x: np.ndarray, y: np.ndarray, score: np.ndarray) -> None:
        self.x, self.y, self.score = np.concatenate([self.x, x]), np.concatenate([self.y, y]), np.concatenate([self.score, score])
        if len(self.x) > HELD:
            self.drop()

    def drop(self) -> None:
        if self.offer is None or not len(self.x):
            return
        side = np.concatenate([self.comp[self.x], self.comp[self.y]])
        order = np.lexsort((-np.concatenate([self.score, self.score]), side))
        head = np.flatnonzero(np.concatenate([[True], side[order][1:] != side[order][:-1]]))
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(head, np.diff(np.concatenate([head, [len(order)]])))
        keep = (nth < self.offer).reshape(2, -1).any(axis=0)
        self.cut[self.comp[self.x[~keep]]] = True
        self.cut[self.comp[self.y[~keep]]] = True
        self.x, self.y, self.score = self.x[keep], self.y[keep], self.score[keep]


def _traverse(num: int, den: int, offer: int | None):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        """(u, v, more): pairs to check; ``more`` if either component held others back."""
        found: dict[tuple[bytes, bytes], bool] = {}
        for _, rows in pdf.groupby("cell", sort=False):
            rows = rows.sort_values("n", kind="stable")
            names, size, comp = rows["fp"].tolist(), rows["n"].to_numpy(np.int64), pd.factorize(rows["comp"])[0]
            maps = Bitmaps(rows["bits"].tolist(), size, den / num)
            tree = SignatureTree(np.zeros(len(size), np.int64), size, comp, np.stack([folded(b, BITS // 8) for b in maps.bits]))
            offers = Offers(comp, offer)
            for x, y in tree.pairs(num, den):
                apart = comp[x] != comp[y]
                x, y = x[apart], y[apart]
                most, both = maps.overlap(x, y), size[x] + size[y]
                ok = (num + den) * most >= num * both
                offers.add(x[ok], y[ok], most[ok] / both[ok])
            offers.drop()
            more = offers.cut[comp[offers.x]] | offers.cut[comp[offers.y]]
            for i, j, m in zip(offers.x.tolist(), offers.y.tolist(), more.tolist(), strict=True):
                pair = (names[i], names[j]) if names[i] < names[j] else (names[j], names[i])
                found[pair] = found.get(pair, False) or m
        return pd.DataFrame({"u": pd.Series([p[0] for p in found], dtype=object), "v": pd.Series([p[1] for p in found], dtype=object), "more": pd.Series(found.values(), dtype=bool)})

    return work


def _checked(num: int, den: int):
    def work(batches):
        """Pairs that link by their whole sets."""
        for b in batches:
            sides = [(c, b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy().view(U64)) for c in ("a", "b")]
            ok = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (flat[at[i] : at[i + 1]] for _, at, flat in sides)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(ok)], ["u", "v", "linked"])

    return work


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW_IDS else df


class _Join:
    """State of one join: documents, classes and stars."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.docs = typed(docs, doc_id="long", text="string").withColumn("digest", F.xxhash64("text"))
        self.levels = word_levels(self.docs)
        self.rows = settle(self.docs.mapInArrow(_profile(self.levels, k, num, den), "doc_id long, digest long, n long, fp binary, prefix array<long>, bits binary"))
        full = self.rows.where(F.col("n") > 0)
        self.classes = settle(full.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first"), F.count(F.lit(1)).alias("copies")))
        # one row per class: the others are those of classes with several rows that are not the first one
        many = settle(self.classes.where("copies > 1").select("fp", F.col("first.doc_id").alias("least"), F.col("first.digest").alias("lead")))
        n = many.count()
        only = self.rows.select("fp", "doc_id", "digest", "n", "prefix", "bits").where("n > 0").join(_few(many, n), "fp", "left_anti")
        first = full.join(_few(many, n), "fp").where(F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("digest") == F.col("lead")))
        self.wide = only.select("fp", "n", "prefix", "bits").union(first.dropDuplicates(["fp"]).select("fp", "n", "prefix", "bits"))
        self.stars = self._stars()
        release(docs.sparkSession)

    def _stars(self) -> DataFrame:
        """(star, fp, n): the classes that may link, by the most shared class of their prefix shingles; ``self.bits`` has their bitmaps (fp, bits)."""
        tokens = self.wide.select("fp", "n", F.explode("prefix").alias("token"))
        members = [F.count(F.lit(1)).alias("m"), *(F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"x{i}") for i in (0, 1))]
        shared = tokens.groupBy("token").agg(*members).where("m > 1").groupBy("m", "x0", "x1").agg(F.min("token").alias("token")).select("token")
        shared = settle(shared)
        n = shared.count()
        #: prefix shingles that at least two classes have, one for each set of classes
        cand = settle(tokens.join(F.broadcast(shared) if n <= FEW_TOKENS else shared, "token"))
        score = settle(cand.groupBy("fp").agg((F.count(F.lit(1)) / F.first("n")).alias("score")))
        scored = cand.select("token", "fp").join(_few(score, score.count()), "fp")
        best = scored.groupBy("token").agg(F.max(F.struct("score", "fp")).alias("p")).select("token", F.col("p.fp").alias("star"))
        held = settle(cand.select("token", "fp", "n").join(best, "token").select("star", "fp", "n").distinct())
        self.bits = settle(self.wide.select("fp", "bits").join(_few(score.select("fp"), score.count()), "fp", "left_semi"))
        return held

    def cells(self, comp: DataFrame | None, only: DataFrame | None) -> DataFrame:
        """(cell, fp, n, comp) of the stars whose classes lie in several components; ``only`` classes of these components."""
        rows = self.stars
        if comp is None:
            rows = rows.withColumn("comp", F.col("fp"))
        else:
            rows = rows.join(_few(comp.withColumnRenamed("node", "fp"), comp.count()), "fp", "left").withColumn("comp", F.coalesce("component", "fp")).drop("component")
        if only is not None:
            rows = rows.join(_few(only, only.count()), "comp", "left_semi")
        rows = settle(rows)
        mixed = settle(rows.groupBy("star").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where(F.col("lo") != F.col("hi")).select("star", "m"))
        rows = rows.join(_few(mixed, mixed.count()), "star")
        # linked sizes are in one size class or in neighbouring ones
        own = F.floor(F.log(F.col("n").cast("double")) / float(np.log(self.den / self.num)) - 1e-6).cast("int")
        rows = rows.withColumn("size_class", F.explode(F.when(F.col("m") > CELL, F.array(own, own + 1)).otherwise(F.array(F.lit(-1)))))
        sizes = settle(rows.where(F.col("m") > CELL).groupBy("star", "size_class").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cut")).where("cut > 1"))
        few = sizes.count()
        if not few:
            return settle(rows.select(F.xxhash64("star", "size_class").alias("cell"), "fp", "n", "comp"))
        rows = rows.join(_few(sizes, few), ["star", "size_class"], "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        return settle(rows.select(F.xxhash64("star", "size_class", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp", "n", "comp"))

    def offered(self, cells: DataFrame, offer: int | None) -> DataFrame:
        """(u, v, more) from the signature trees; bitmaps move to the cells once."""
        total = cells.agg(F.sum(F.greatest(F.col("n"), F.lit(BITS // 8)) / 2 + 100)).first()[0] or 0
        parts = parts_for(self.docs.sparkSession, total, 8 << 20)
        rows = cells.join(self.bits, "fp").withColumn("part", F.pmod("cell", F.lit(parts)))
        found = rows.groupBy("part").applyInPandas(_traverse(self.num, self.den, offer), "u binary, v binary, more boolean")
        return settle(found.groupBy("u", "v").agg(F.max("more").alias("more")))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of the ``pairs`` that link by their whole sets; the sets are taken from the texts of one row per class."""
        wanted = settle(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct())
        few = wanted.count()
        firsts = settle(self.classes.join(_few(wanted, few), "fp", "left_semi").select("first.doc_id", "first.digest").distinct())
        reps = _few(firsts.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")), few)
        texts = self.docs.join(reps, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left_semi")
        sets = texts.mapInArrow(_sets(self.levels, self.k), "fp binary, items array<long>")
        sets = settle(sets.join(_few(wanted, few), "fp", "left_semi").dropDuplicates(["fp"]))
        a = sets.select(F.col("fp").alias("u"), F.col("items").alias("a"))
        b = sets.select(F.col("fp").alias("v"), F.col("items").alias("b"))
        return settle(pairs.select("u", "v").join(a, "u").join(b, "v").mapInArrow(_checked(self.num, self.den), "u binary, v binary, linked boolean").where("linked").select("u", "v"))

    def components(self) -> DataFrame:
        """(node, component) of the classes that link with others."""
        spark, links, comp, only = self.docs.sparkSession, None, None, None
        for offer in OFFERS:
            pairs = self.offered(self.cells(comp, only), offer)
            new = self.linked(pairs)
            links = new if links is None else links.union(new)
            comp = components(links)
            release(spark)
            held = settle(pairs.where("more").select(F.explode(F.array("u", "v")).alias("node")).distinct().join(comp, "node", "left").select(F.coalesce("component", "node").alias("comp")).distinct())
            if held.isEmpty():
                break
            only = held
        return comp

    def labelled(self) -> DataFrame:
        """(fp, component, first) of the classes with several rows or links; ``first`` is the class's first row (null doc_ids last)."""
        of = self.classes.join(self.components().withColumnRenamed("node", "fp"), "fp", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
        return settle(of.select("fp", F.coalesce("component", "fp").alias("component"), "first"))


def shingle_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text): sets link when ``den`` x overlap >= ``num`` x union."""
    with scratch_scope(docs.sparkSession) as keep:
        j = _Join(docs, k, num, den)
        of = j.labelled()
        least = of.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
        named = of.join(least, "component").select("fp", "component_id")
        out = j.rows.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
        return keep(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id (null last), of texts with that doc_id one. Rows without a shingle all stay."""
    with scratch_scope(docs.sparkSession) as keep:
        j = _Join(docs, k, num, den)
        of = j.labelled()
        first = of.groupBy("component").agg(F.min("first").alias("winner"))
        named = of.join(first, "component").select("fp", "winner")
        rows = j.rows.select("doc_id", "digest", "fp").join(named, "fp")
        same = F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("digest") == F.col("winner.digest"))
        gone = keep(rows.where(~same).select("doc_id", "digest").distinct())
        twice = keep(rows.where(same).groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"))
    digest = F.xxhash64(F.col("text").cast("string"))
    key = [fresh(docs, "_doc"), fresh(docs, "_digest")]
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(key[0])) & (digest == F.col(key[1]))
    kept = docs.join(_few(gone.toDF(*key), gone.count()), match, "left_anti")
    if twice.isEmpty():
        return kept
    again = _few(twice.toDF(*key), twice.count())
    return kept.join(again, match, "left_anti").unionByName(kept.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))


@query("op9_shingle_jaccard")
def op9(spark, sf):
    return shingle_groups(read(spark, sf, "documents"), k=3, num=90, den=100)
