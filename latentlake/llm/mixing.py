"""Operator 2: mix sources to target token weights by entropy balancing.

The rates are the maximum-entropy answer to one token constraint per source: with rates between 0 and ``cap`` and base rate ``cap / 2``,
each document's odds are tilted exponentially, ``r / (cap - r) = exp(lambda_s * size / mean_s)``. The multipliers minimise a convex dual, whose
Newton steps are distributed aggregates. Documents of equal source and size have equal rates, so the dual is summed over the exact histogram
(source, size, count) and never over documents again.

Rounding: cells of the histogram are rounded to whole copies from the largest size to the smallest, each carrying its error on, so that a
source misses its target by about half of its smallest documents. The copies of a cell go to its documents in an order keyed by hash.

Defined cases: null text has size 0, is never taken and its target still counts; a null source is a source of its own (last); an empty table
gives no rows; repeated rows are documents of their own; other columns are ignored. Same input and seed, same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, query, read, release, scratch_scope, settle, typed, word_count

#: Documents of a cell that one task ranks.
RANK_BLOCK = 20_000
NEWTON_STEPS = 60
#: Sources up to which their table (a name and a few numbers each) is broadcast; beyond, it is joined by a shuffle.
SMALL_SOURCES = 100_000


def water_filled(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """(source, source_size, weight) plus ``target``: shares of ``share`` x all sizes by weight, each at most ``cap`` x its size.

    The level rises by Newton steps on a concave, piecewise linear function; each step is one aggregate over the sources, and the steps end
    exactly when no further source meets its cap.
    """
    full = F.col("source_size") * F.lit(float(cap))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goal, level, seen = float(total) * share, 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) >= full
        row = sources.agg(
            F.sum(F.when(capped, full).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.sum(capped.cast("int")).alias("n"),
        ).first()
        if row["n"] is None or row["n"] == seen or not row["free"]:
            break
        seen, level = row["n"], max(level, (goal - row["fixed"]) / row["free"])
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), full).cast("double"))


def _ordinal(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, numbered from 0 in ranges, so that no task sorts them all."""
    ranged = settle(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_p", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").isNull(), F.col("source"))) - 1
    before, total = [], 0
    for p, n in sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect()):  # a row per range partition
        before.append((p, total))
        total += n
    if not before:
        return ranged.select("source", "source_size", F.lit(0).cast("long").alias("ordinal"))
    starts = F.create_map(*(F.lit(x) for pair in before for x in pair))
    return ranged.select("source", "source_size", (starts[F.col("_p")] + inside).cast("long").alias("ordinal"))


def dual(cells: DataFrame, cap: float, tolerance: float = 1e-9) -> DataFrame:
    """Multipliers ``lam`` by source for (source, size, n, target, mean): damped Newton on the dual, one aggregate over all cells a step.

    A bracket around each root keeps the steps safe; sources whose target is all or nothing of their reach get an infinite multiplier.
    The state is a table of one row per source, written in each step.
    """
    state = settle(
        cells.groupBy("source", "target", "mean")
        .agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("total"))
        .select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
                (F.col("total") * F.lit(cap)).alias("reach"), F.lit(False).alias("done"))
    )
    for _ in range(NEWTON_STEPS):
        open_ = state.where(~F.col("done")).select(F.col("source").alias("key"), "mean", "lam")
        left = open_.count()
        if not left:
            break
        x = F.col("size") / F.col("mean")
        rate = F.lit(cap) / (1 + F.exp(-F.col("lam") * x))
        sums = (
            cells.select("source", "size", "n").join(F.broadcast(open_) if left <= SMALL_SOURCES else open_, F.col("source").eqNullSafe(F.col("key")))
            .select("key", (F.col("n") * F.col("size") * rate).alias("g"),
                    (F.col("n") * F.col("size") * x * rate * (1 - rate / F.lit(cap))).alias("h"))
            .groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        )
        gap = F.col("g") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.col("h")
        inside = (F.col("h") > 0) & (step > lo) & (step < hi) & (F.abs(step - F.col("lam")) <= 4 + 4 * F.abs(F.col("lam")))
        away = F.when(gap > 0, F.col("lam") - 4 - F.abs(F.col("lam"))).otherwise(F.col("lam") + 4 + F.abs(F.col("lam")))
        middle = F.when((lo == float("-inf")) | (hi == float("inf")), away).otherwise((lo + hi) / 2)
        end = F.when(F.col("target") >= F.col("reach") * (1 - 1e-12), F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf")))
        fits = F.abs(gap) <= F.lit(tolerance) * F.greatest(F.col("target"), F.lit(1.0))
        stepped = state.join(sums, F.col("source").eqNullSafe(F.col("key")), "left")
        state = settle(
            stepped.select(
                "source", "target", "mean",
                F.when(F.col("done"), F.col("lam")).otherwise(F.coalesce(end, F.when(F.col("g").isNull() | fits, F.col("lam")), F.when(inside, step), middle)).alias("lam"),
                F.when(F.col("done") | F.col("g").isNull(), F.col("lo")).otherwise(lo).alias("lo"),
                F.when(F.col("done") | F.col("g").isNull(), F.col("hi")).otherwise(hi).alias("hi"),
                "reach", (F.col("done") | end.isNotNull() | F.col("g").isNull() | fits).alias("done"),
            )
        )
        release(cells.sparkSession)  # steps are small and many; else the driver's heap grows by what it keeps of each
    return state.select("source", "lam")


def _round_source(cap: int):
    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole copies for the cells of one source, largest size first; a cell holds at most ``cap`` copies a document."""
        pdf = pdf.sort_values("size", ascending=False)
        copies, due = [], 0.0
        for size, n, rate in zip(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy(), strict=True):
            if size <= 0:
                copies.append(0)
                continue
            due += float(size) * n * rate
            k = int(min(max(np.floor(due / size + 0.5), 0), cap * n))
            due -= float(size) * k
            copies.append(k)
        return pdf.assign(copies=np.array(copies, np.int64))[["source", "size", "n", "rate", "copies"]]

    return work


def mix_plan(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: int = 2, seed: int = 0) -> DataFrame:
    """(doc_id, size, source, source_size, target, rate, copies) for every row of ``docs`` (doc_id, text, source).

    Sources in code-point order, null last, take ``weights`` in turn. A task of the rounding step holds the distinct sizes of one source,
    at most the square root of twice its words.
    """
    sized = settle(typed(docs, doc_id="long", text="string", source="string").select("doc_id", "source", word_count("text").alias("size")))
    counted = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.lit(0.0)
    for i, w in enumerate(weights):
        weight = F.when(F.col("ordinal") % len(weights) == i, F.lit(float(w))).otherwise(weight)
    sources = settle(water_filled(settle(_ordinal(sources).withColumn("weight", weight)), share, float(cap)))
    s = sources.select(F.col("source").alias("key"), "source_size", "target")
    s = F.broadcast(s) if s.count() <= SMALL_SOURCES else s
    docs_of = counted.groupBy("source").agg(F.sum("n").alias("docs")).select(F.col("source").alias("key2"), "docs")
    cells = settle(
        counted.join(s, F.col("source").eqNullSafe(F.col("key"))).join(docs_of, F.col("source").eqNullSafe(F.col("key2")))
        .select("source", "size", "n", "source_size", "target", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0)).alias("mean"))
    )
    release(docs.sparkSession)
    lam = dual(cells, float(cap)).select(F.col("source").alias("key"), "lam")
    rated = cells.join(lam, F.col("source").eqNullSafe(F.col("key"))).select(
        "source", "size", "n",
        F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.lit(float(cap)) / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean")))).alias("rate"),
    )
    rounded = rated.groupBy("source").applyInPandas(_round_source(cap), "source string, size long, n long, rate double, copies long")
    # copies of a cell among its documents: blocks of a hashed order, each with its share of the cell's surplus copies
    blocks = F.ceil(F.col("n") / RANK_BLOCK).cast("long")
    keyed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    quota = settle(rounded.withColumn("blocks", F.greatest(blocks, F.lit(1))))
    release(docs.sparkSession)
    q = quota.select(F.col("source").alias("key"), F.col("size").alias("key_size"), "n", "rate", "copies", "blocks")
    placed = (
        sized.join(q, F.col("source").eqNullSafe(F.col("key")) & (F.col("size") == F.col("key_size")))
        .select("doc_id", "source", "size", "n", "rate", "copies", keyed.alias("draw"), F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("blocks")).alias("block"))
    )
    in_block = placed.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("block"))
    surplus = F.col("copies") - F.floor(F.col("copies") / F.col("n")) * F.col("n")
    cut = lambda to: F.floor(surplus * to / F.col("n"))
    share_of = in_block.withColumn("upto", upto).select(
        F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("block").alias("b_block"),
        (cut(F.col("upto")) - cut(F.col("upto") - F.col("m"))).alias("extra"),
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy("draw", "doc_id"))
    ranked = placed.withColumn("rank", rank).join(
        share_of, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("block") == F.col("b_block"))
    )
    copies = (F.floor(F.col("copies") / F.col("n")) + (F.col("rank") <= F.col("extra")).cast("long")).cast("long")
    chosen = ranked.select("doc_id", "size", "source", "rate", copies.alias("copies"))
    return chosen.join(s, F.col("source").eqNullSafe(F.col("key"))).select("doc_id", "size", "source", "source_size", "target", "rate", "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as its plan says; rows without a copy go.

    Rows of equal doc_id, source and size share the copies planned for them.
    """
    key, rows, copies, nth = (fresh(docs, x) for x in ("key", "rows", "copies", "nth"))
    same = lambda size: F.to_json(F.struct(F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), size.alias("n")))
    with scratch_scope(docs.sparkSession) as keep:
        plan = keep(mix_plan(docs, **options).groupBy(same(F.col("size")).alias(key)).agg(F.count(F.lit(1)).alias(rows), F.sum("copies").alias(copies)))
    release(docs.sparkSession)
    joined = docs.withColumn(key, same(word_count("text"))).join(plan.where(F.col(copies) > 0), key)
    numbered = joined.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    upto = lambda i: F.floor(i * F.col(copies) / F.col(rows)).cast("int")
    times = upto(F.col(nth)) - upto(F.col(nth) - 1)
    return numbered.withColumn(nth, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


@query("op2_mix_sources")
def op2(spark, sf):
    plan = mix_plan(read(spark, sf, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")
