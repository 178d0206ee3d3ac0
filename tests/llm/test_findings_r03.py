"""Findings of review 3 on the training-data operators."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latentlake.llm import decontam, jaccard, mixing, quality, suffixes, tokens

from llm_helpers import SF, docs_of


def test_shards_send_only_the_weights_they_moved(spark):
    """The driver's share follows the words of the sample, not the shards times the table of all words."""
    words, docs, each = 40_000, 420, 10
    rows = spark.range(docs).select(
        F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda j: ((F.col("id") * each + j) * 9).cast("int")).alias("items"),
        (F.col("id") % 2).cast("double").alias("y_quality"), F.lit(0.0).alias("y_toxic"), F.lit(1.0).alias("weight"),
    ).repartition(211, "doc_id").select("items", "y_quality", "y_toxic", "weight")
    columns, weights = np.arange(words, dtype=np.int32), np.zeros((2, words), np.float32)
    parts = rows.mapInArrow(quality._epoch(columns, weights, np.zeros(2), 0.4, 1e-4), "shard int, at binary, moved binary, b binary").collect()
    assert len(parts) > 100
    assert 0 < sum(len(r["moved"]) for r in parts) <= docs * each * 2 * 4
    at = np.concatenate([np.frombuffer(r["at"], np.int32) for r in parts])
    assert np.array_equal(np.sort(at), np.arange(docs * each) * 9)


def test_equal_cuts_of_near_copies_are_one_row(spark):
    """op1: a group of near copies is cut into rows by its different strings, not by its copies, and single strings move without bytes."""
    rng = np.random.default_rng(3)
    base, n, length = rng.integers(97, 123, 1000, np.uint8), 300, 400
    full = []
    for i in range(n):
        copy = base.copy()
        copy[rng.integers(0, 1000)] = 48 + i % 10
        full.append((i.to_bytes(2, "big"), b"k", copy.tobytes(), 1))
    schema = "pid binary, key binary, seg binary, mult long, parent binary, at long, a array<long>, b array<long>"
    for width, size in ((48, 1000), (1, 440)):
        pieces = [(pid, key, seg[:size], m) for pid, key, seg, m in full]
        rows = spark.createDataFrame(pieces, "pid binary, key binary, seg binary, mult long").coalesce(1)
        got = rows.mapInArrow(suffixes._recut(length, width), schema).collect()
        children = [r for r in got if r["pid"] is not None]
        cuts = [(key, seg[lo : lo + c + length - 1], pid, lo, c) for pid, _, seg, _ in pieces for key, lo, c in suffixes._cut(seg, length, width)]
        assert len({r["pid"] for r in children}) == len(children) == len({c[:2] for c in cuts}) < len(cuts) * 2 / 3
        assert sum(r["mult"] for r in children) == len(cuts)
        assert width > 1 or all(r["seg"] is None for r in children)
        # the starts that are not linked are those that other pieces have too
        times = Counter(c[:2] for c in cuts)
        known = {(r["parent"], x) for r in got if r["pid"] is None for lo, hi in zip(r["a"], r["b"], strict=True) for x in range(lo, hi)}
        assert known == {(pid, x) for *cut, pid, lo, c in cuts if times[tuple(cut)] > 1 for x in range(lo, lo + c)}
        assert {(r["parent"], r["at"]) for r in children if r["parent"]} == {(pid, lo) for *cut, pid, lo, _ in cuts if times[tuple(cut)] == 1}


def test_rounds_release_what_the_driver_kept(spark, monkeypatch):
    """pipeline: the driver's heap is emptied once a round of training and once a Newton step of the mix."""
    calls, rounds = [], []
    for module in (quality, mixing):
        monkeypatch.setattr(module, "release", lambda spark, of=module.__name__: calls.append(of))
    epoch = quality._epoch
    monkeypatch.setattr(quality, "_epoch", lambda *a: rounds.append(1) or epoch(*a))
    docs = docs_of(spark, [(i, "good words here " * (i % 7 + 1), f"s{i % 3}") for i in range(40)])
    assert quality.quality_scores(docs).count() == 40
    assert len(rounds) > 1 and calls.count(quality.__name__) == len(rounds)
    settled = []
    settle = mixing.settle
    monkeypatch.setattr(mixing, "settle", lambda df: settled.append(df.columns) or settle(df))
    assert mixing.mix_plan(docs).count() == 40
    steps = sum(c[:4] == ["source", "target", "mean", "lam"] for c in settled) - 1
    assert steps > 1 and calls.count(mixing.__name__) >= steps


@pytest.mark.parametrize("k, module, name", [(0, quality, "keep_good"), (1, jaccard, "keep_one"), (2, decontam, "drop_contaminated"), (3, mixing, "mixed_documents"), (4, tokens, "ordered_sequences")])
def test_stages_bound_batches_by_bytes(spark, monkeypatch, k, module, name):
    """pipeline: long texts do not come to Python 10,000 at once, so what a task holds outside the heap does not follow their length."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    monkeypatch.setattr(module, name, lambda df, *_, **__: docs.mapInArrow(sizes, "n long, size long").collect())
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda *_: "/tmp/none")
    got = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert sum(r["n"] for r in got) == 3000
    assert max(r["size"] for r in got) < 2_500_000
    assert spark.conf.get(setting, None) is None
    spark.conf.set(setting, "1m")
    try:
        got = corpus_pipeline.STAGES[k][1](spark, docs, SF)
        assert max(r["size"] for r in got) < 1_500_000 and spark.conf.get(setting) == "1m"
    finally:
        spark.conf.unset(setting)
