"""Prototype codes of a latent's top tiles, and target / clamp values from their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake.operators.encode import LatentModel, encode_hits
from latentlake.operators.filters import first_n
from latentlake.runtime import attach_small, settle

_KEYS = ["slide_key", "tile_index"]


def top_tile_codes(top: DataFrame, tiles: DataFrame, model: LatentModel, top_n: int = 0) -> DataFrame:
    """Non-zero codes of each latent's top tiles: ``(latent_idx, slide_key, tile_index, score, dim, z)``.

    Only the tiles named in the top lists are read, and each is encoded once even
    when several latents share it.
    """
    wanted = first_n(top, top_n).select("latent_idx", *_KEYS, F.col("z").alias("score"))
    # keys only are settled and attached, so vectors stay where they are
    named = tiles.join(attach_small(settle(wanted.select(*_KEYS).distinct())), _KEYS, "left_semi")
    codes = encode_hits(named, model).select(*_KEYS, F.col("latent_idx").alias("dim"), "z")
    return wanted.join(codes, _KEYS)


def _found(top: DataFrame, tiles: DataFrame, top_n: int) -> DataFrame:
    rows = first_n(top, top_n).select("latent_idx", *_KEYS, F.col("z").alias("score"))
    here = tiles.select(*_KEYS).join(attach_small(settle(rows.select(*_KEYS).distinct())), _KEYS, "left_semi")
    return rows.join(here, _KEYS)


def prototype_dims(codes: DataFrame, found: DataFrame) -> DataFrame:
    """Mean and median of every code dimension that is non-zero somewhere (G13, long form).

    A latent has at most ``top_n`` tiles, so the value list of a (latent, dim) is
    that short; missing values are zeros.
    """
    sizes = found.groupBy("latent_idx").agg(F.count("*").alias("n"))
    values = codes.groupBy("latent_idx", "dim").agg(F.collect_list("z").alias("v"), F.sum("z").alias("s"))
    full = values.join(sizes, "latent_idx").withColumn(
        "v", F.sort_array(F.concat("v", F.array_repeat(F.lit(0.0), (F.col("n") - F.size("v")).cast("int"))))
    )
    low = F.get("v", F.floor((F.col("n") - 1) / 2).cast("int"))
    high = F.get("v", F.floor(F.col("n") / 2).cast("int"))
    return full.select(
        "latent_idx",
        "dim",
        (F.col("s") / F.col("n")).alias("proto_mean"),
        ((low + high) / 2).alias("proto_median"),
    )


def prototypes(top: DataFrame, tiles: DataFrame, model: LatentModel, top_n: int = 0) -> DataFrame:
    """``(latent_idx, prototype_mean, prototype_median)`` as dense arrays of the code width."""
    latent_dim, _ = model.shape()
    top = settle(top)
    dims = prototype_dims(top_tile_codes(top, tiles, model, top_n), _found(top, tiles, top_n))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.struct("dim", c)))
    packed = dims.groupBy("latent_idx").agg(pairs("proto_mean").alias("a"), pairs("proto_median").alias("b"))
    axis = F.sequence(F.lit(0).cast("bigint"), F.lit(latent_dim - 1).cast("bigint"))
    dense = lambda m: F.transform(axis, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
    return packed.select(
        "latent_idx",
        dense(F.col("a")).alias("prototype_mean"),
        dense(F.col("b")).alias("prototype_median"),
    )


def prototype_stats(top: DataFrame, tiles: DataFrame, model: LatentModel, top_n: int = 0) -> DataFrame:
    """Self-activation spread, raw-score mean, prototype norms and slide counts."""
    top = settle(top)
    codes, found = settle(top_tile_codes(top, tiles, model, top_n)), _found(top, tiles, top_n)
    own = codes.where(F.col("dim") == F.col("latent_idx")).select("latent_idx", *_KEYS, "z")
    self_z = F.coalesce("z", F.lit(0.0))
    rows = found.join(own, ["latent_idx", *_KEYS], "left")
    stats = rows.groupBy("latent_idx").agg(
        F.count("*").alias("top_tiles_used"),
        F.count_distinct("slide_key").alias("unique_slide_count"),
        F.avg("score").alias("raw_score_mean"),
        F.min(self_z).alias("self_min"),
        F.percentile(self_z, [0.5, 0.75, 0.9]).alias("p"),
        F.max(self_z).alias("self_max"),
        F.avg(self_z).alias("self_mean"),
        F.stddev_pop(self_z).alias("self_std"),
    )
    dims = prototype_dims(codes, found)
    norms = dims.groupBy("latent_idx").agg(
        F.sqrt(F.sum(F.col("proto_mean") * F.col("proto_mean"))).alias("prototype_mean_l2"),
        F.sqrt(F.sum(F.col("proto_median") * F.col("proto_median"))).alias("prototype_median_l2"),
    )
    quantiles = [F.get("p", F.lit(i)).alias(f"self_{name}") for i, name in enumerate(("p50", "p75", "p90"))]
    out = stats.select("*", *quantiles).drop("p").join(norms, "latent_idx", "left")
    return out.fillna(0.0, ["prototype_mean_l2", "prototype_median_l2"])


def top_abs_dims(dims: DataFrame, value: str = "proto_mean", k: int = 16) -> DataFrame:
    """k largest dimensions of each prototype by magnitude."""
    order = Window.partitionBy("latent_idx").orderBy(F.abs(value).desc(), "dim")
    ranked = dims.withColumn("dim_rank", F.row_number().over(order)).where(F.col("dim_rank") <= k)
    return ranked.select("latent_idx", "dim_rank", "dim", F.col(value).alias("value"))


def prototype_skips(selected: DataFrame, top: DataFrame, tiles: DataFrame, d_in: int) -> DataFrame:
    """Selected latents that yield no prototype, with the reason."""
    rows = settle(top.select("latent_idx", *_KEYS))
    widths = tiles.join(attach_small(settle(rows.select(*_KEYS).distinct())), _KEYS, "left_semi").select(*_KEYS, F.size("features").alias("d"))
    seen = rows.join(widths, _KEYS, "left")
    per = seen.groupBy("latent_idx").agg(
        F.count("slide_key").alias("valid"), F.count("d").alias("loaded"), F.count_if(F.col("d") != d_in).alias("bad")
    )
    joined = selected.select("latent_idx").join(per, "latent_idx", "left")
    reason = (
        F.when(F.col("valid").isNull(), "missing_or_empty_top_tiles")
        .when(F.col("valid") == 0, "no_valid_records")
        .when(F.col("loaded") == 0, "all_tile_loads_failed")
        .when(F.col("bad") > 0, "bad_feature_shape")
    )
    return joined.select("latent_idx", reason.alias("reason")).where("reason is not null")


# Percentiles reported for top scores.
TARGET_PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def targets(top: DataFrame, score: str = "z", top_n: int = 0) -> DataFrame:
    """Count, extremes, percentiles, mean and deviation of a latent's top scores."""
    rows = first_n(top, top_n).where(F.col(score).isNotNull())
    s = F.col(score).cast("double")
    packed = rows.groupBy("latent_idx").agg(
        F.count("*").alias("count"),
        F.min(s).alias("min"),
        F.percentile(s, [q / 100.0 for q in TARGET_PERCENTILES]).alias("_p"),
        F.max(s).alias("max"),
        F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std"),
    )
    flat = [F.get("_p", F.lit(i)).alias(f"p{q}") for i, q in enumerate(TARGET_PERCENTILES)]
    return packed.select("*", *flat).drop("_p")


def target_presets(stats: DataFrame) -> DataFrame:
    """Target and clamp levels per latent."""
    return stats.select(
        "latent_idx",
        F.col("count").alias("source_top_tiles_count_used"),
        F.col("p50").alias("target_soft"),
        F.col("p75").alias("target_medium"),
        F.col("p90").alias("target_strong"),
        F.col("p95").alias("target_very_strong"),
        F.col("p75").alias("clamp_soft"),
        F.col("p50").alias("clamp_medium"),
        F.col("p25").alias("clamp_strong"),
    )


def target_skips(selected: DataFrame, stats: DataFrame) -> DataFrame:
    """Selected latents without any score."""
    return selected.select("latent_idx").join(stats, "latent_idx", "left_anti")


def flat_target_maps(stats: DataFrame) -> DataFrame:
    """One row of latent -> value maps; one entry per selected latent (G16, JSON edge)."""
    entry = lambda c: F.map_from_entries(
        F.sort_array(F.collect_list(F.struct(F.col("latent_idx").cast("string"), F.col(c))))
    )
    return stats.agg(*[entry(c).alias(f"target_{c}") for c in ("p50", "p75", "p90")])
