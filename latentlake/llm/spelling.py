"""Operator 13: spelling variants of words by blocked Gram matrices of letter counts.

1. Words are counted over all texts; those of at least ``shortest`` letters and ``rarest`` occurrences take part.
2. The letters are dealt into groups of about equal weight. Words of equal length with equal counts per group make a block. One inserted letter
   moves a word to a block of the next length, one replaced letter to a block of the same length with one letter moved between two groups; so
   each block meets itself and a few others, and no pair of near words is missed, however the letters are grouped. The number of groups
   follows the number of words, so that blocks stay small; blocks are cut into chunks of ``CHUNK`` words, which meet one by one.
3. In a task the letter counts of two chunks are multiplied: ``|a|^2 + |b|^2 - 2ab`` is 1 for one inserted letter and 2 for one replaced letter.
   Pairs of larger distance go; of the others the edit itself is verified, letter by letter.
4. A task returns one row per word that it has seen near others: how many, and the best of them. No pair leaves a task.
5. Forms are followed to the last one by pointer doubling: frequencies at least double from word to form, so chains are short.

Defined cases: null and blank texts have no words; of equally frequent near words the one first in code-point order is the form; texts of equal
doc_id are counted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, query, read, scratch_scope, settle, typed

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block that are one side of a product; larger blocks are cut by hash.
CHUNK = 1024
#: Bits of a group's count in a block key; larger counts wrap, which puts more words into a block and separates none that are near.
COUNT_BITS = 6
#: Words that meet in a task, about.
PART_WORDS = 300_000


def word_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, word): every run of letters of ``docs`` (doc_id, text) with A-Z in lower case."""
    text = F.translate("text", UPPER, LOWER)
    return typed(docs, doc_id="long", text="string").select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("word"))


def with_lost_letters(words: DataFrame) -> DataFrame:
    """``words`` (doc_id, word) in which one in 97, chosen by checksum, has lost a letter; none where doc_id is null."""
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "word"))
    at = (h % F.length("word")).cast("int")
    short = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    return words.withColumn("word", F.when(F.col("doc_id").isNotNull() & (h % 97 == 0), short).otherwise(F.col("word")))


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters dealt into groups of about equal weight, heaviest first; at most one row per letter comes to the driver."""
    rows = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().orderBy(F.desc("count"), "letter").collect()
    out, load = [""] * groups, [0] * groups
    for r in rows:
        least = load.index(min(load))
        out[least] += r["letter"]
        load[least] += r["count"]
    return [g for g in out if g]


def block_key(groups: list[str]) -> Column:
    """Counts per group of letters."""
    key = F.lit(0).cast("long")
    for g in groups:
        held = F.length("word") - F.length(F.translate("word", g, ""))
        key = F.shiftleft(key, COUNT_BITS).bitwiseOR(held.cast("long") % (1 << COUNT_BITS))
    return key


def visited(groups: int) -> Column:
    """The blocks (size, key) whose words a block meets: its own, those with one letter more, those with one letter moved to a later group."""
    full = (1 << COUNT_BITS) - 1

    def moved(k: Column, g: int, by: int) -> Column:
        place = COUNT_BITS * (groups - 1 - g)
        held = F.shiftright(k, place).bitwiseAND(F.lit(full).cast("long"))
        return k.bitwiseAND(F.lit(~(full << place))).bitwiseOR(F.shiftleft(F.pmod(held + by, F.lit(full + 1)), place))

    size, key = F.col("size"), F.col("key")
    one = lambda s, k: F.struct(s.alias("home_size"), k.alias("home"))
    longer = [one(size + 1, moved(key, g, 1)) for g in range(groups)]
    same = [one(size, moved(moved(key, g, -1), h, 1)) for g in range(groups) for h in range(g + 1, groups)]
    return F.array(one(size, key), *longer, *same)


def letter_counts(words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), 256), np.float32)
    for column in words.T:
        out[np.arange(len(words)), column] += 1
    return out


def near_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) of words one edit apart; the words of ``b`` are as long as those of ``a`` or one letter longer."""
    x, y = letter_counts(a), letter_counts(b)
    used = np.flatnonzero(x.any(axis=0) & y.any(axis=0))
    longer = b.shape[1] - a.shape[1]
    length = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None]
    i, j = np.nonzero(length - 2 * (x[:, used] @ y[:, used].T) == (1 if longer else 2))
    p, q = a[i], b[j]
    if longer:
        head = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(axis=1)
        tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        ok = head + tail >= a.shape[1]
    else:
        ok = (p != q).sum(axis=1) == 1
    return i[ok], j[ok]


class _Best:
    """Per word the number of near words seen and the best of them: the most frequent, then the first in order."""

    def __init__(self):
        self.rows: dict[bytes, tuple[int, int, bytes]] = {}

    def add(self, at: np.ndarray, met: np.ndarray, words: np.ndarray, others: np.ndarray, n: np.ndarray) -> None:
        """``words[at]`` are near ``others[met]``, which occur ``n[met]`` times."""
        if not len(at):
            return
        order = np.lexsort((*others[met].T[::-1], -n[met], at))
        at, met = at[order], met[order]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        times = np.diff(np.concatenate([head, [len(at)]]))
        for w, o, t, m in zip(words[at[head]], others[met[head]], times.tolist(), n[met[head]].tolist(), strict=True):
            word, other = w.tobytes(), o.tobytes()
            had = self.rows.get(word)
            if had is None:
                self.rows[word] = (t, m, other)
            elif (-m, other) < (-had[1], had[2]):
                self.rows[word] = (t + had[0], m, other)
            else:
                self.rows[word] = (t + had[0], had[1], had[2])

    def frame(self) -> pd.DataFrame:
        cols = list(zip(*self.rows.values(), strict=True)) or [[]] * 3
        text = lambda x: pd.Series([w.decode("latin-1") for w in x], dtype=object)
        return pd.DataFrame({"word": text(self.rows), "near": pd.Series(cols[0], dtype="int64"), "n": pd.Series(cols[1], dtype="int64"), "other": text(cols[2])})


def _stacked(rows: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows["words"]), np.uint8).reshape(-1, size), np.concatenate(rows["ns"].to_list()).astype(np.int64)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    best = _Best()
    for (size, _, _), rows in pdf.groupby(["home_size", "home", "chunk"], sort=False):
        if not rows["own"].any():  # a chunk that hashing left empty
            continue
        host, n = _stacked(rows[rows["own"]], size)
        i, j = near_pairs(host, host)
        best.add(i, j, host, host, n)
        for width in (size, size - 1):
            guests = rows[~rows["own"] & (rows["size"] == width)]
            for lo in range(0, len(guests), 16):
                guest, m = _stacked(guests.iloc[lo : lo + 16], width)
                i, j = near_pairs(guest, host)
                best.add(i, j, guest, host, n)
                best.add(j, i, host, guest, m)
    return best.frame()


def near_words(counts: DataFrame) -> DataFrame:
    """(word, near, best) of the ``counts`` (word, n; distinct words of letters up to U+00FF) that have near words; best is (least -n, other)."""
    spark = counts.sparkSession
    total = counts.count()
    groups = letter_groups(counts, min(max(2, round(log2(max(total, 1)) / 3)), 10))
    words = counts.select("word", "n", F.length("word").alias("size"), block_key(groups).alias("key"))
    sizes = settle(words.groupBy("size", "key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    held = words.join(sizes, ["size", "key"]).groupBy("size", "key", "chunks", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int").alias("guest")).agg(F.collect_list(F.struct("word", "n")).alias("w"))
    held = settle(held.select("size", "key", "guest", F.encode(F.array_join("w.word", ""), "ISO-8859-1").alias("words"), F.col("w.n").alias("ns")))
    hosts = sizes.select(F.col("size").alias("home_size"), F.col("key").alias("home"), "chunks")
    visits = held.select("*", F.explode(visited(len(groups))).alias("v")).select("size", "key", "guest", "words", "ns", "v.*").join(hosts, ["home_size", "home"])
    visits = visits.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    inside = (F.col("home_size") == F.col("size")) & (F.col("home") == F.col("key"))
    visits = visits.where(~inside | (F.col("chunk") <= F.col("guest"))).withColumn("own", inside & (F.col("chunk") == F.col("guest")))
    parts = parts_for(spark, total * (1 + len(groups) * (len(groups) + 1) / 2), PART_WORDS)
    part = F.pmod(F.xxhash64("home_size", "home", "chunk"), F.lit(parts))
    found = visits.select("home_size", "home", "chunk", "own", "size", "words", "ns", part.alias("part")).groupBy("part").applyInPandas(_compare, "word string, near long, n long, other string")
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last one."""
    at = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = settle(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_forms(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``counts`` (word, n): the form is the best near word if it is ``ratio`` times as frequent."""
    with scratch_scope(counts.sparkSession) as keep:
        counts = settle(counts.select("word", "n"))
        near = near_words(counts)
        fits = -F.col("best.n") >= ratio * F.col("n")
        found = settle(
            counts.join(near, "word", "left")
            .select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"))
        )
        last = roots(found.where(F.col("form").isNotNull()))
        return keep(found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def frequent_words(words: DataFrame, shortest: int = 5, rarest: int = 3) -> DataFrame:
    """(word, n) of the ``words`` (word) that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)


@query("op13_spelling_variants")
def op13(spark, sf):
    return spelling_forms(frequent_words(with_lost_letters(word_runs(read(spark, sf, "documents")))))
