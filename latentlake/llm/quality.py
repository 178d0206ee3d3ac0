"""Operator 4: quality classifier from weak labels.

1. Overlapping heuristic labellers vote on each document: good, bad or no vote. Annotations, where there are any, are one more labeller.
2. Expectation-maximisation over the counts of all vote patterns (of all documents) estimates the class share and, for each labeller, how it
   votes on good and on bad documents when it votes. The posterior of its pattern is a document's label; without a vote it has none.
3. The posteriors of a bounded sample train a linear scorer on hashed words and hashed buckets of the labellers' measurements: the annotated
   documents of lowest hash, ``SAMPLE`` at most, and ``SAMPLE / WEAK_SHARE`` others at the lower ``WEAK_WEIGHT``, by one rule at every size. Shards
   run an epoch each, their weights are averaged, and so on for some rounds; weights of rare words are shrunk, none is cut.
4. The scorer decides on every document. There are two heads of this kind: quality and toxicity. A document stays if it is of good quality
   and not toxic.

Defined cases: null text is empty; texts without words get no votes and, having no words, the scorer's base rate; annotations of unknown
documents and null annotations are ignored, of several the worse one counts; repeated rows are scored each; an empty table gives no rows; other
columns are ignored. Without labels the heuristics alone are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, query, read, release, scratch_scope, settle, typed
from .kernels import LOWER, U64, chunks, distinct, mix, shingles, text_bytes, word_bounds, word_hashes

#: Documents that train the scorer, at most; everything else is computed over all.
SAMPLE = 30_000
BUCKETS = 1 << 18
SHARDS, ROUNDS = 8, 8
#: Documents without annotation that join the sample, as a share of its bound, and their weight: labellers err alike on what nobody has annotated.
WEAK_SHARE, WEAK_WEIGHT = 6, 0.1
#: A word's weight is shrunk as if it had been seen in so many more documents of the sample, where it said nothing.
SHRINK = 2.0
FEW_IDS = 500_000
#: Insults whose presence makes the toxicity labellers vote.
INSULTS = (
    "bastard clown cretin disgusting dumb dumbass filth filthy fool garbage idiot imbecile jerk loser lunatic moron pathetic pig retard scum "
    "stupid sucker trash twat ugly vermin vile worthless wretch"
).split()
#: Quality labellers: measurement, and the ranges in which they vote bad and good.
VOTERS = (
    ("symbols", lambda x: x > 0.05, lambda x: x < 0.01),
    ("capitals", lambda x: x > 0.5, lambda x: x < 0.2),
    ("repeats", lambda x: x > 0.3, lambda x: x < 0.1),
    ("sentences", lambda x: (x < 0.005) | (x > 0.5), lambda x: (x > 0.016) & (x < 0.34)),
    ("top_word", lambda x: x > 0.25, lambda x: x < 0.12),
    ("word_length", lambda x: (x < 2) | (x > 20), lambda x: (x > 3) & (x < 14)),
)
MEASURES = [name for name, _, _ in VOTERS]
#: Edges of the buckets in which measurements become features of the scorer.
EDGES = {
    "symbols": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2), "capitals": (0.05, 0.1, 0.2, 0.35, 0.5, 0.8), "repeats": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "sentences": (0.005, 0.016, 0.04, 0.1, 0.2, 0.34, 0.5), "top_word": (0.04, 0.08, 0.12, 0.18, 0.25, 0.5), "word_length": (2, 3, 4, 6, 9, 14, 20),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!*#$%&|<>{}[]=~^@\\_+`"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[offsets]).astype(np.int64)  # a slice is far below 2**31


def _distinct(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sorted distinct (document, 44-bit value) pairs, packed; a slice has fewer than 2**20 documents."""
    return distinct((doc.astype(U64) << U64(44)) | (values >> U64(20)))


class Measured:
    """Words and measurements of one slice of texts."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        n = len(offsets) - 1
        low = LOWER[raw]
        starts, ends, first = word_bounds(raw, offsets)
        self.count = np.diff(first)
        self.doc = np.repeat(np.arange(n), self.count)
        some = np.maximum(self.count, 1)
        full = np.maximum(_sums(np.ones(len(starts), np.int64) * (ends - starts), first), 1)
        plain_starts, plain_ends = starts.copy(), ends.copy()
        for _ in range(4):  # up to four marks on either side, which is what decorated words have
            cut = np.flatnonzero((plain_starts < plain_ends - 1) & _EDGE[raw[plain_starts]]) if len(raw) else []
            plain_starts[cut] += 1
            cut = np.flatnonzero((plain_starts < plain_ends - 1) & _EDGE[raw[plain_ends - 1]]) if len(raw) else []
            plain_ends[cut] -= 1
        self.words = word_hashes(low, plain_starts, plain_ends)
        grams, at = shingles(self.words, first, 3)
        grams_doc = np.repeat(np.arange(n), np.diff(at))
        kinds = np.bincount((_distinct(grams_doc, grams) >> U64(44)).astype(np.int64), minlength=n)
        packed = np.sort((self.doc.astype(U64) << U64(44)) | (self.words >> U64(20)))
        head = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, np.int64)
        often = np.diff(np.concatenate([head, [len(packed)]]))
        self.pairs = packed = packed[head]
        top = np.zeros(n, np.int64)
        np.maximum.at(top, (packed >> U64(44)).astype(np.int64), often)
        letters = np.maximum(_sums(_LETTER[raw], offsets), 1)
        short = self.count < 10
        m = {
            "symbols": _sums(_SYMBOL[raw], offsets) / full, "capitals": _sums(_UPPER[raw], offsets) / letters, "repeats": 1 - kinds / np.maximum(np.diff(at), 1),
            "sentences": _sums(_STOP[raw[ends - 1]] if len(raw) else np.zeros(0, bool), first) / some, "top_word": top / some, "word_length": full / some,
        }
        self.measures = {k: np.where(self.count == 0, np.nan, v) for k, v in m.items()}
        for k in ("repeats", "top_word", "sentences"):
            self.measures[k][short] = np.nan
        self.measures["sentences"][self.count < 30] = np.nan
        self.measures["top_word"][self.count < 30] = np.nan

    def insults(self) -> np.ndarray:
        """Different insults in each document."""
        found = np.isin(self.pairs & U64((1 << 44) - 1), insult_values())
        return np.bincount((self.pairs[found] >> U64(44)).astype(np.int64), minlength=len(self.count))

    def votes(self) -> np.ndarray:
        """Documents x labellers: 0 bad, 1 none, 2 good; the last two vote on toxicity: 0 toxic, 1 none, 2 not."""
        out = []
        for name, bad, good in VOTERS:
            x = self.measures[name]
            out.append(np.where(np.isnan(x), 1, np.where(bad(np.nan_to_num(x)), 0, np.where(good(np.nan_to_num(x)), 2, 1))))
        kinds = self.insults()
        out.append(np.where(self.count == 0, 1, np.where(kinds > 0, 0, 2)))
        out.append(np.where(kinds > 1, 0, 1))
        return np.stack(out, axis=1).astype(np.int8)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket) of each present feature, in document order."""
        doc = [(self.pairs >> U64(44)).astype(np.int64)]
        bucket = [(self.pairs & U64(BUCKETS - 1)).astype(np.int64)]
        coded = [np.where(np.isnan(self.measures[k]), 15, np.digitize(np.nan_to_num(self.measures[k]), EDGES[k])) for k in MEASURES]
        for i, code in enumerate([*coded, np.minimum(self.insults(), 3)]):
            x = code
            doc.append(np.arange(len(x)))
            bucket.append((mix(code.astype(U64) + U64(1000 * (i + 1))) & U64(BUCKETS - 1)).astype(np.int64))
        doc, bucket = np.concatenate(doc), np.concatenate(bucket)
        order = np.argsort(doc, kind="stable")
        return doc[order], bucket[order]


def insult_values() -> np.ndarray:
    raw, offsets = text_bytes(pa.array([" ".join(INSULTS)]))
    starts, ends, _ = word_bounds(raw, offsets)
    return np.sort(word_hashes(raw, starts, ends) >> U64(20))


HEADS = {"quality": list(range(len(VOTERS))), "toxic": [len(VOTERS), len(VOTERS) + 1]}


def vote_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, votes as a string of digits) of every row."""

    def work(batches):
        for b in chunks(batches, "text"):
            v = Measured(b.column("text")).votes() + 48
            flat = pa.StringArray.from_buffers(len(v), pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]).buffers()[1], pa.py_buffer(v.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "votes"])

    return typed(docs, doc_id="long", text="string").mapInArrow(work, "doc_id long, votes string")


def label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, per labeller its chance to vote good on bad and on good documents when it votes, posterior of good per pattern).

    Expectation-maximisation over distinct vote patterns (0 bad, 1 none, 2 good), from the majority of the votes, in which the last labeller (the
    annotations) counts double; patterns without a vote do not count and have no posterior. A labeller is taken to be right more often than not.
    """
    good, bad = (patterns == 2).astype(float), (patterns == 0).astype(float)
    voted = (good + bad).sum(axis=1) > 0
    weight = counts * voted
    strength = np.ones(patterns.shape[1])
    strength[-1] = 2
    post = np.clip(0.5 + 0.4 * np.sign((good - bad) @ strength), 0.1, 0.9)
    share, says_good = 0.5, np.full((2, patterns.shape[1]), 0.5)
    for _ in range(steps):
        each = np.stack([(1 - post) * weight, post * weight])
        share = float((each[1].sum() + 1) / (weight.sum() + 2))
        says_good = (each @ good + [[0.1], [0.9]]) / (each @ (good + bad) + 1)
        says_good = np.clip(says_good, [[0.001], [0.5]], [[0.5], [0.999]])
        odds = good @ np.log(says_good[1] / says_good[0]) + bad @ np.log((1 - says_good[1]) / (1 - says_good[0])) + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return share, says_good, np.where(voted, post, np.nan)


def _posteriors(votes: DataFrame, head: str) -> dict[str, float]:
    """Posterior of good (quality) or of not toxic per vote pattern; the patterns of all documents, 3 to the number of labellers at most."""
    found = votes.groupBy(f"p_{head}").count().toPandas().sort_values(f"p_{head}")
    if not len(found):
        return {}
    patterns = np.array([[int(c) for c in p] for p in found[f"p_{head}"]])
    post = label_model(patterns, found["count"].to_numpy(float))[2]
    return {p: x for p, x in zip(found[f"p_{head}"], post.tolist(), strict=True) if x == x}


def _sample_features(docs: DataFrame) -> DataFrame:
    def work(batches):
        for b in chunks(batches, "text"):
            doc, bucket = Measured(b.column("text")).features()
            off = np.searchsorted(doc, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(bucket, pa.int32()))
            names = ["y_quality", "y_toxic", "weight"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, *(b.column(c) for c in names)], ["doc_id", "items", *names])

    return docs.mapInArrow(work, "doc_id long, items array<int>, y_quality double, y_toxic double, weight double")


def _epoch(columns: np.ndarray, weights: np.ndarray, bias: np.ndarray, rate: float, decay: float):
    """One epoch of both heads on one shard, in the order of a hash of doc_id; ``columns`` are the buckets that have weights."""

    def work(batches):
        place = np.full(BUCKETS, -1, np.int32)
        place[columns] = np.arange(len(columns), dtype=np.int32)
        w, b = weights.copy(), bias.copy()
        seen = np.zeros(w.shape, np.float32)
        none = True
        for items, y0, y1, much in _labelled(batches):
            none = False
            x = place[items]
            x = x[x >= 0]
            z = w[:, x].sum(axis=1) + b
            g = much * np.nan_to_num(1 / (1 + np.exp(-np.clip(z, -30, 30))) - (y0, y1))  # no label, no step
            step = g[:, None] + decay * w[:, x]
            seen[:, x] += step * step
            w[:, x] -= rate * step / np.sqrt(seen[:, x] + 1.0)
            b -= 0.3 * rate * g
        if none:
            return
        at = np.flatnonzero((w != weights).any(axis=0)).astype(np.int32)
        row = [TaskContext.get().partitionId()], [at.tobytes()], [(w - weights)[:, at].astype(np.float32).tobytes()], [b.astype(np.float64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(),) + (pa.binary(),) * 3, strict=True)], ["shard", "at", "moved", "b"])

    return work


def _labelled(batches):
    """(items, label of quality, label of toxicity, weight) of each document; a missing label is not a number."""
    for b in batches:
        lists = b.column("items")
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        labels = [b.column(c).to_numpy(zero_copy_only=False) for c in ("y_quality", "y_toxic", "weight")]
        for lo, hi, *of in zip(np.concatenate([[0], ends[:-1]]), ends, *labels, strict=True):
            yield flat[lo:hi], *of


def _document_counts(batches):
    seen = np.zeros(BUCKETS, np.int64)
    for items, *_ in _labelled(batches):
        seen[distinct(items)] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([seen[at].astype(np.int32).tobytes()])], ["at", "n"])


def train(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets with weights, weights of both heads, biases) from (doc_id, items, y_quality, y_toxic, weight): parameter averaging over ``SHARDS`` shards for ``ROUNDS`` rounds.

    What comes to the driver are the weights that each shard moved: no more than the words of the bounded sample, however many shards there are.
    """
    turn = F.xxhash64(F.lit(7), F.col("doc_id"))
    # one file per shard, in order; a shard is what one task reads, so rounds shuffle nothing
    rows = settle(sample.withColumn("turn", turn).repartition(SHARDS, "turn").sortWithinPartitions("turn", "doc_id")).select("items", "y_quality", "y_toxic", "weight")
    seen = np.zeros(BUCKETS, np.int64)
    for r in rows.mapInArrow(_document_counts, "at binary, n binary").collect():
        seen[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.int32)
    columns = np.flatnonzero(seen).astype(np.int32)
    weights, bias = np.zeros((2, len(columns)), np.float32), np.zeros(2)
    for i in range(ROUNDS):
        parts = rows.mapInArrow(_epoch(columns, weights, bias, 0.4 / (1 + i), 1e-4), "shard int, at binary, moved binary, b binary").collect()
        if not parts:
            break
        parts.sort(key=lambda r: r["shard"])
        # a weight is averaged over the shards that moved it
        total, shards = np.zeros_like(weights), np.zeros(len(columns), np.int64)
        for r in parts:
            at = np.frombuffer(r["at"], np.int32)
            total[:, at] += np.frombuffer(r["moved"], np.float32).reshape(2, -1)
            shards[at] += 1
        weights = (weights + total / np.maximum(shards, 1)).astype(np.float32)
        bias = np.mean([np.frombuffer(r["b"], np.float64) for r in parts], axis=0)
        del parts
        release(sample.sparkSession)  # what a round sent would else stay in the driver's heap until that is full
    return columns, weights * (seen[columns] / (seen[columns] + SHRINK)).astype(np.float32), bias


def quality_scores(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep, text_hash) for every row of ``docs`` (doc_id, text); ``labels`` (doc_id, quality, toxic) is optional."""
    rows = typed(docs, doc_id="long", text="string")
    votes = vote_table(rows)
    if labels is not None:
        known = typed(labels, doc_id="long", quality="int", toxic="int").groupBy(F.col("doc_id").alias("known")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        votes = votes.join(known, F.col("doc_id") == F.col("known"), "left")
    else:
        votes = votes.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    n = len(VOTERS)
    votes = settle(
        votes.select(
            "doc_id", F.concat(F.substring("votes", 1, n), F.when(F.col("quality") > 0, "2").when(F.col("quality") <= 0, "0").otherwise("1")).alias("p_quality"),
            F.concat(F.substring("votes", n + 1, 2), F.when(F.col("toxic") > 0, "0").when(F.col("toxic") <= 0, "2").otherwise("1")).alias("p_toxic"),
        )
    )
    annotated = F.substring("p_quality", n + 1, 1).isin("0", "2") | F.substring("p_toxic", 3, 1).isin("0", "2")
    turn = [F.xxhash64(F.lit(3), F.col("doc_id")), F.col("doc_id")]
    known = votes.where(annotated).orderBy(*turn).limit(sample).withColumn("weight", F.lit(1.0))
    picked = known.union(votes.where(~annotated).orderBy(*turn).limit(sample // WEAK_SHARE).withColumn("weight", F.lit(WEAK_WEIGHT)))
    for head in HEADS:
        table = _posteriors(votes, head)
        pairs = [F.lit(x) for p in table.items() for x in p]
        value = F.try_element_at(F.create_map(*pairs), F.col(f"p_{head}")) if pairs else F.lit(None).cast("double")
        picked = picked.withColumn(f"y_{head}", value if head == "quality" else 1 - value)
    chosen = settle(picked.groupBy(F.col("doc_id").alias("chosen")).agg(F.avg("y_quality").alias("y_quality"), F.avg("y_toxic").alias("y_toxic"), F.max("weight").alias("weight")))
    texts = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", "text", "y_quality", "y_toxic", "weight")  # a bounded sample
    table = docs.sparkSession.sparkContext.broadcast(train(_sample_features(texts)))  # a weight per bucket and head at most

    def score(batches):
        at, w, b = table.value
        dense = np.zeros((2, BUCKETS), np.float32)
        dense[:, at] = w
        for batch in chunks(batches, "text"):
            doc, bucket = Measured(batch.column("text")).features()
            z = [np.bincount(doc, dense[h, bucket], minlength=batch.num_rows) + b[h] for h in (0, 1)]
            good, bad = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(good), pa.array(bad), pa.array((good >= 0.5) & (bad < 0.5)), batch.column("text_hash")], ["doc_id", "p_quality", "p_toxic", "keep", "text_hash"]
            )

    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(score, "doc_id long, p_quality double, p_toxic double, keep boolean, text_hash long")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, told apart by doc_id and text."""
    with scratch_scope(docs.sparkSession) as keep:
        scores = quality_scores(docs, labels, sample)
        bad = keep(scores.where(~F.col("keep")).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_text")).distinct())
    side = F.broadcast(bad) if bad.count() <= FEW_IDS else bad
    key = fresh(docs, "text_hash")
    return docs.withColumn(key, F.xxhash64(F.col("text").cast("string"))).join(side, F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (F.col(key) == F.col("bad_text")), "left_anti").select(*docs.columns)


@query("op4_quality")
def op4(spark, sf):
    scores = quality_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return scores.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), "keep")
