"""Exact order statistics by rank selection: no group's values are ever brought together.

The range that holds a rank is cut into bins, counts per bin are summed on the map side, and the one bin that holds the rank becomes the range of
the next round. Bins are equal in width between the range's least and largest value, both of which lie in bins of their own, so every round
makes the range smaller. It ends where a range holds one value, or so few that their order can be read from a short window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake.runtime import attach_small, settle

BINS = 1024
#: Distinct values of a range that a window puts in order.
FEW = 2048


def at_ranks(values: DataFrame, targets: DataFrame, by: str, bins: int = BINS, few: int = FEW) -> DataFrame:
    """``(by, rank, value)``: the value that stands at ``rank`` (from 0) among the ``values`` (by, z, freq) of its group.

    ``targets`` is (by, rank), a few ranks per group. Each value counts ``freq`` times; null and NaN values do not count. Ranks behind the
    last value give no row. ``values`` is read once per round, so it should be stored.
    """
    values = values.where(F.col("z").isNotNull() & ~F.isnan("z") & (F.col("freq") > 0)).select(by, "z", "freq")
    whole = values.groupBy(by).agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.sum("freq").alias("n"), F.count("*").alias("rows"))
    ranges = targets.join(whole, by).where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).withColumn("before", F.lit(0).cast("long"))
    ranges = settle(ranges.select(by, "rank", "before", "lo", "hi", "rows"))
    found = []
    one, short = F.col("lo") == F.col("hi"), F.col("rows") <= few
    while True:
        found.append(ranges.where(one).select(by, "rank", F.col("lo").alias("value")))
        last = ranges.where(~one & short)
        inside = (F.col("z") >= F.col("lo")) & (F.col("z") <= F.col("hi"))
        if not last.isEmpty():
            upto = F.sum("freq").over(Window.partitionBy(by, "rank").orderBy("z")) + F.col("before")
            held = values.join(attach_small(last), by).where(inside).select(by, "rank", "z", upto.alias("upto"))
            found.append(held.where(F.col("upto") > F.col("rank")).groupBy(by, "rank").agg(F.min("z").alias("value")))
        ranges = ranges.where(~one & ~short)
        if ranges.isEmpty():
            break
        # halves keep the width of a range finite
        share = (F.col("z") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        binned = values.join(attach_small(ranges), by).where(inside).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = binned.groupBy(by, "rank", "bin").agg(
            F.sum("freq").alias("n"), F.count("*").alias("rows"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.first("before").alias("before")
        )
        upto = F.sum("n").over(Window.partitionBy(by, "rank").orderBy("bin")) + F.col("before")
        holds = (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto"))
        ranges = settle(counts.withColumn("upto", upto).where(holds).select(by, "rank", (F.col("upto") - F.col("n")).alias("before"), "lo", "hi", "rows"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def percentiles(values: DataFrame, q: float, by: str, **how: int) -> DataFrame:
    """``(by, value)``: the percentile ``q`` (0 to 100) of each group of ``values`` (by, z, freq), interpolated between neighbours."""
    place = (F.sum("freq") - 1) * F.lit(q / 100.0)
    of = settle(values.where(F.col("z").isNotNull() & ~F.isnan("z") & (F.col("freq") > 0)).groupBy(by).agg(place.alias("place")))
    ranks = F.array_distinct(F.array(F.floor("place"), F.ceil("place")))
    at = at_ranks(values, of.select(by, F.explode(ranks).alias("rank")), by, **how)
    low = F.max(F.when(F.col("rank") == F.floor("place"), F.col("value")))
    high = F.max(F.when(F.col("rank") == F.ceil("place"), F.col("value")))
    share = F.first("place") - F.floor(F.first("place"))
    return at.join(of, by).groupBy(by).agg((low * (1 - share) + high * share).alias("value"))
