"""Top tiles per latent and the diversity rules on top of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake.operators.encode import margin, rank_top
from latentlake.operators.filters import keep_latents


def top_tiles(acts: DataFrame, selected: DataFrame | None, n: int, positive: bool = True) -> DataFrame:
    """Best n tiles per (selected) latent with ``source_rank`` (H4, H8).

    Dense activations drop z <= 0; pass ``positive=False`` for TopK hits.
    """
    if positive:
        acts = acts.where(F.col("z") > 0)
    if selected is not None:
        acts = keep_latents(acts, selected)
    return rank_top(acts, n)


def overfetch(topn: int, factor: float) -> int:
    """Candidates to mine before the diversity rules cut them back."""
    return topn if factor <= 1.0 else math.ceil(topn * factor)


def cap_per_slide(top: DataFrame, per_slide: int, keys: tuple[str, ...] = ("latent_idx",)) -> DataFrame:
    """At most ``per_slide`` rows per (latent, slide) in rank order (H6)."""
    if per_slide <= 0:
        return top
    order = Window.partitionBy(*keys, "slide_key").orderBy("source_rank")
    return top.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_slide).drop("_n")


def diversify(
    top: DataFrame, topn: int = 0, per_slide: int = 3, min_px: int = 512, keys: tuple[str, ...] = ("latent_idx",)
) -> DataFrame:
    """Greedy per-slide cap and minimum spacing in rank order, then the first ``topn`` (H6, H7).

    Input is a top list, so a (latent, slide) group never exceeds the mined
    candidates. Slides are independent; ``source_rank`` is renumbered.
    """
    if min_px > 0:
        row = F.struct("source_rank", "tile_index", "coord_x", "coord_y", "z")
        grouped = top.groupBy(*keys, "slide_key").agg(F.sort_array(F.collect_list(row)).alias("rows"))
        limit = F.lit(per_slide if per_slide > 0 else 2**31 - 1)

        def near(a, b):
            dx = (a["coord_x"] - b["coord_x"]).cast("double")
            dy = (a["coord_y"] - b["coord_y"]).cast("double")
            return dx * dx + dy * dy < float(min_px) ** 2

        def keep(acc, r):
            full = F.size(acc) >= limit
            return F.when(full | F.exists(acc, lambda k: near(k, r)), acc).otherwise(F.concat(acc, F.array(r)))

        kept = grouped.withColumn("rows", F.aggregate("rows", F.slice("rows", 1, 0), keep))
        out = kept.select(*keys, "slide_key", F.inline("rows"))
    else:
        out = cap_per_slide(top, per_slide, keys)
        out = out.select(*keys, "slide_key", "source_rank", "tile_index", "coord_x", "coord_y", "z")
    order = Window.partitionBy(*keys).orderBy("source_rank")
    out = out.withColumn("source_rank", F.row_number().over(order))
    return out.where(F.col("source_rank") <= topn) if topn > 0 else out


def concept_tiles(
    acts: DataFrame, latent: int, k: int, latent_dim: int, use_margin: bool = True, tiles: DataFrame | None = None
) -> DataFrame:
    """Best k tiles of one latent, by activation or by its margin over the others.

    Pass ``tiles`` to rank tiles without any hit too; all their values are zero.
    """
    keys = ["slide_key", "tile_index"]
    if use_margin and latent_dim >= 2:
        own = margin(acts, latent_dim).where(F.col("latent_idx") == latent).select(*keys, "margin")
        rest = acts.groupBy(*keys).agg(
            F.max("z").alias("best"), F.count("*").alias("n"), F.max((F.col("latent_idx") == latent)).alias("own")
        )
        # where the latent itself is zero, its margin is minus the best other value
        other = F.when(F.col("n") < latent_dim - 1, F.greatest("best", F.lit(0.0))).otherwise(F.col("best"))
        absent = rest.where(~F.col("own")).select(*keys, (-other).alias("margin"))
        ranked = own.unionByName(absent).withColumnRenamed("margin", "concept_score")
    else:
        ranked = acts.where(F.col("latent_idx") == latent).select(*keys, F.col("z").alias("concept_score"))
    if tiles is not None:
        silent = tiles.select(*keys).join(ranked.select(*keys), keys, "left_anti")
        ranked = ranked.unionByName(silent.withColumn("concept_score", F.lit(0.0)))
    return ranked.orderBy(F.col("concept_score").desc(), *keys).limit(k)
