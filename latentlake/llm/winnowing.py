"""Operator 3: document fingerprints by winnowing.

Each text is hashed in grams of ``K`` code points; of every ``W`` consecutive grams the least hash is kept, the rightmost among equal ones, with its
position. Any passage of ``K + W - 1`` code points that two texts share therefore leaves a common fingerprint entry in both. A text shorter than a
gram is one gram; fewer than ``W`` grams are one window.

A fingerprint is a string of 20 hex digits per entry: 12 of the hash, 8 of the position, in text order. Likeness is the Jaccard similarity of
the hashes without positions; two empty fingerprints have 1.

``edited_pairs`` compares each text with an edited one whose last half is taken from the next document. Documents are cut into blocks by ranges of
doc_id; the first document of a block is also dealt to the block before, so the text moves once and no task sees more than a block.

Defined cases: null text is empty; null doc_ids come first in the order, equal doc_ids are ordered by text; one document alone is its own
neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, query, read, typed
from .kernels import U64, distinct, mix, rolling, windows_min

#: 19 shared code points, half of a text of 38, leave a common entry.
K, W = 8, 12
#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
_NULL_FIRST = np.iinfo(np.int64).min


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(points: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hashes, positions) of the kept grams."""
    if not len(points):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if len(points) < k:
        h = U64(len(points))
        for p in points.astype(U64):
            h = mix(np.array([h], U64) * U64(3) + p)[0]
        return np.array([h >> U64(16)], U64), np.zeros(1, np.int64)
    hashes = rolling(points, k)
    # the order is by the top 32 bits; among equal ones the larger position comes first
    order = (hashes & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - np.arange(len(hashes), dtype=U64))
    least = windows_min(order, w)
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    at = (U64(0xFFFFFFFF) - (least & U64(0xFFFFFFFF))).astype(np.int64)
    return hashes[at] >> U64(16), at


def encoded(hashes: np.ndarray, at: np.ndarray) -> str:
    rows = np.empty((len(hashes), 10), np.uint8)
    rows[:, :6] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    rows[:, 6:] = at.astype(">u4").view(np.uint8).reshape(-1, 4)
    return rows.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets given as sorted distinct arrays."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text)."""

    def work(batches):
        for b in batches:
            prints = [encoded(*winnow(code_points(t or ""), k, w)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return typed(docs, doc_id="long", text="string").mapInArrow(work, "doc_id long, fingerprint string")


def _deal(bounds: np.ndarray):
    """Adds the block of each row; the first document of a block goes to the block before as well, the very first to the last."""

    def work(batches):
        for b in batches:
            ids = b.column("doc_id").fill_null(_NULL_FIRST).to_numpy(zero_copy_only=False)
            block = np.searchsorted(bounds, ids, "right") - 1
            lead = np.flatnonzero(bounds[block] == ids)
            rows = np.concatenate([np.arange(len(ids)), lead])
            before = np.where(block[lead] > 0, block[lead] - 1, len(bounds) - 1)
            role = np.concatenate([np.zeros(len(ids), np.int32), np.where(block[lead] > 0, 1, 2).astype(np.int32)])
            taken = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([block, before])), pa.array(role), taken.column("doc_id"), taken.column("text")], ["block", "role", "doc_id", "text"])

    return work


_PAIR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(k: int, w: int):
    def finish(doc, text, print_, following, next_print):
        n = len(text)
        half = n // 2
        edited = text[: n - half] + following[:half]
        e_hash, e_at = winnow(code_points(edited), k, w)
        own, other = distinct(print_[0]), distinct(next_print[0])
        return (doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(*print_), encoded(e_hash, e_at), likeness(own, distinct(e_hash)), likeness(own, other))

    def flush(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _PAIR.split(", ")])

    def work(batches):
        rows, held, last = [], 0, None
        for b in batches:
            for block, role, doc, text in zip(*(b.column(c).to_pylist() for c in ("block", "role", "doc_id", "text")), strict=True):
                text = text or ""
                if last is not None and last[0] != block:
                    last = None
                if role and last is None:
                    continue
                now = (block, doc, text, winnow(code_points(text), k, w))
                if last is not None:
                    rows.append(finish(*last[1:], text, now[3]))
                    held += 3 * len(last[2])
                last = None if role else now
                if held > 4 << 20:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return work


def edited_pairs(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and the likeness to the latter and to the next document's."""
    rows = typed(docs, doc_id="long", text="string")
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = parts_for(spark, size, BLOCK_BYTES)
    ranged = rows.select("doc_id").repartitionByRange(blocks, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(
        F.min(F.coalesce("doc_id", F.lit(int(_NULL_FIRST)))).alias("least")
    )
    found = sorted(r["least"] for r in ranged.collect())  # one number per block
    if not found:
        return spark.createDataFrame([], _PAIR)
    bounds = np.unique(np.array(found, np.int64))
    dealt = rows.mapInArrow(_deal(bounds), "block long, role int, doc_id long, text string")
    placed = dealt.repartitionById(len(bounds), F.col("block").cast("int")).sortWithinPartitions("block", F.when(F.col("role") == 2, 1).otherwise(0), "doc_id", "text")
    return placed.mapInArrow(_compare(k, w), _PAIR)


@query("op3_winnowing")
def op3(spark, sf):
    return edited_pairs(read(spark, sf, "documents"))
