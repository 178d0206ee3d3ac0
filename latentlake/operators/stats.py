"""Latent statistics over sparse activations; zeros are implicit, so tile counts travel along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.operators.order_stats import percentiles
from latentlake.runtime import settle


def count_tiles(tiles: DataFrame) -> DataFrame:
    """``(slide_key, total_tiles)``; reads only the key column."""
    return tiles.groupBy("slide_key").agg(F.count("*").alias("total_tiles"))


def latent_partials(hits: DataFrame, n_tiles: Column) -> DataFrame:
    """Per-latent max, sum, sum of squares and hit count (G1 over stored hits)."""
    return (
        hits.groupBy("latent_idx")
        .agg(
            F.max("z").alias("z_max"),
            F.sum("z").alias("z_sum"),
            F.sum(F.col("z") * F.col("z")).alias("z_sum_sq"),
            F.count("*").alias("nnz"),
        )
        .withColumn("n_tiles", n_tiles)
        .select("latent_idx", "n_tiles", "z_max", "z_sum", "z_sum_sq", "nnz")
    )


def slide_partials(hits: DataFrame) -> DataFrame:
    """Per (slide, latent) partials from stored hits."""
    z = F.col("z")
    return hits.groupBy("slide_key", "latent_idx").agg(
        F.max("z").alias("z_max"),
        F.sum("z").alias("z_sum"),
        F.sum(z * z).alias("z_sum_sq"),
        F.coalesce(F.sum(F.when(z > 0, z)), F.lit(0.0)).alias("pos_sum"),
        F.count_if(z > 0).alias("pos_n"),
        F.count_if(z != 0).alias("nz_n"),
    )


def latent_stats(hits: DataFrame, n_tiles: Column, latent_dim: int, kind: str = "dense") -> DataFrame:
    """Partials for every latent in ``[0, latent_dim)``: unseen dense latents have max 0, TopK null."""
    spark = hits.sparkSession
    dims = spark.range(latent_dim).select(F.col("id").alias("latent_idx"))
    seen = latent_partials(hits, n_tiles)
    out = dims.join(seen.drop("n_tiles"), "latent_idx", "left").withColumn("n_tiles", n_tiles)
    peak = F.col("z_max")
    if kind == "dense":
        # hits hold z > 0 only, so any missing tile contributes a zero
        peak = F.coalesce(peak, F.lit(0.0))
    return out.select(
        "latent_idx",
        "n_tiles",
        peak.alias("z_max"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("z_sum", "z_sum_sq")],
        F.coalesce("nnz", F.lit(0)).alias("nnz"),
    )


def stats_from_slides(partials: DataFrame, n_tiles: Column, latent_dim: int) -> DataFrame:
    """Dense latent statistics from per-slide partials, without a second encode pass."""
    per = partials.groupBy("latent_idx").agg(
        F.max("z_max").alias("z_max"),
        F.sum("z_sum").alias("z_sum"),
        F.sum("z_sum_sq").alias("z_sum_sq"),
        F.sum("pos_n").alias("nnz"),
    )
    dims = partials.sparkSession.range(latent_dim).select(F.col("id").alias("latent_idx"))
    return dims.join(per, "latent_idx", "left").select(
        "latent_idx",
        n_tiles.alias("n_tiles"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("z_max", "z_sum", "z_sum_sq")],
        F.coalesce("nnz", F.lit(0)).alias("nnz"),
    )


def finalize_stats(partials: DataFrame) -> DataFrame:
    """Add mean, population variance (floored at 0) and sparsity."""
    n = F.greatest(F.col("n_tiles"), F.lit(1))
    mean = F.col("z_sum") / n
    return (
        partials.withColumn("mean", mean)
        .withColumn("variance", F.greatest(F.col("z_sum_sq") / n - mean * mean, F.lit(0.0)))
        .withColumn("sparsity", 1.0 - F.col("nnz") / n)
    )


def slide_summary(partials: DataFrame, counts: DataFrame, latents: Column) -> DataFrame:
    """Mean, max and non-zero fraction per (slide, latent), zero-filled over ``latents``."""
    n = F.col("total_tiles")
    skeleton = counts.where(n > 0).withColumn("latent_idx", F.explode(latents))
    peak = F.when(F.coalesce("nz_n", F.lit(0)) < n, F.greatest("z_max", F.lit(0.0))).otherwise(F.col("z_max"))
    return skeleton.join(partials, ["slide_key", "latent_idx"], "left").select(
        "slide_key",
        "latent_idx",
        (F.coalesce("z_sum", F.lit(0.0)) / n).alias("z_mean"),
        F.coalesce(peak, F.lit(0.0)).alias("z_max"),
        (F.coalesce("nz_n", F.lit(0)) / n).alias("z_nzfrac"),
    )


def activation_monitor(hits: DataFrame, n_tiles: Column, latent_dim: int) -> DataFrame:
    """Global fraction non-zero, non-zeros per tile, mean, std and top-1 minus top-2."""
    z = F.col("z")
    # a tile has at most latent_dim hits, which bounds the list
    per_tile = hits.groupBy("slide_key", "tile_index").agg(
        F.count_if(z != 0).alias("nz"),
        F.sum("z").alias("s"),
        F.sum(z * z).alias("sq"),
        F.count("*").alias("rows"),
        F.slice(F.sort_array(F.collect_list("z"), asc=False), 1, 2).alias("top"),
    )
    missing = F.least(F.lit(2), F.lit(latent_dim) - F.col("rows")).cast("int")
    best = F.sort_array(F.concat("top", F.array_repeat(F.lit(0.0), missing)), asc=False)
    gap = F.get(best, F.lit(0)) - F.get(best, F.lit(1)) if latent_dim >= 2 else F.lit(0.0)
    parts = per_tile.agg(
        F.sum("nz").alias("nz"), F.sum("s").alias("z_sum"), F.sum("sq").alias("z_sum_sq"), F.sum(gap).alias("gap")
    )
    return monitor_ratios(parts.withColumn("n_tiles", n_tiles), latent_dim)


def monitor_ratios(parts: DataFrame, latent_dim: int) -> DataFrame:
    """Monitor figures from summed partials ``(n_tiles, nz, z_sum, z_sum_sq, gap)``."""
    total = parts.agg(*[F.sum(c).alias(c) for c in ("n_tiles", "nz", "z_sum", "z_sum_sq", "gap")])
    n = F.col("n_tiles")
    cells = n * F.lit(float(latent_dim))
    mean = F.col("z_sum") / cells
    return total.select(
        (F.col("nz") / cells).alias("frac_nonzero"),
        (F.col("nz") / n).alias("mean_nonzero_per_sample"),
        mean.alias("z_mean"),
        F.sqrt(F.greatest(F.col("z_sum_sq") / cells - mean * mean, F.lit(0.0))).alias("z_std"),
        (F.col("gap") / n).alias("top1_top2_margin"),
    )


def dead_units(hits: DataFrame, n_tiles: Column, latent_dim: int, eps: float = 0.0) -> DataFrame:
    """Fraction of latents never above ``eps`` in magnitude; mean and max of mean |z|."""
    size = F.abs("z")
    per_latent = hits.groupBy("latent_idx").agg(
        F.max(F.when(size > eps, 1).otherwise(0)).alias("active"), F.sum(size).alias("l1")
    )
    return per_latent.agg(
        (1.0 - F.coalesce(F.sum("active"), F.lit(0)) / latent_dim).alias("dead_frac"),
        (F.coalesce(F.sum("l1"), F.lit(0.0)) / n_tiles / latent_dim).alias("mean_abs_act_per_latent"),
        (F.coalesce(F.max("l1"), F.lit(0.0)) / n_tiles).alias("max_abs_act_per_latent"),
    )


def dead_units_from_stats(partials: DataFrame, latent_dim: int, eps: float = 0.0) -> DataFrame:
    """dead_units() of a dense model from its latent partials: activations equal their magnitude."""
    mean = F.col("z_sum") / F.greatest("n_tiles", F.lit(1))
    return partials.agg(
        (1.0 - F.coalesce(F.count_if(F.col("z_max") > eps), F.lit(0)) / latent_dim).alias("dead_frac"),
        (F.coalesce(F.sum(mean), F.lit(0.0)) / latent_dim).alias("mean_abs_act_per_latent"),
        F.coalesce(F.max(mean), F.lit(0.0)).alias("max_abs_act_per_latent"),
    )


def reconstruction_error(recon: DataFrame, latent_dim: int) -> DataFrame:
    """Element-mean squared error and mean |z| over a reconstruct() table."""
    gap = F.zip_with("features", "x_hat", lambda x, y: F.pow(x.cast("double") - y, 2))
    err = F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v)
    return recon.agg(
        (F.sum(err) / F.sum(F.size("features"))).alias("mse"),
        (F.sum("z_l1") / (F.count("*") * F.lit(latent_dim))).alias("l1"),
    )


def parent_usage(coeffs: DataFrame) -> DataFrame:
    """Mean coefficient per parent, normalised to sum to one (G27 rows)."""
    mean = coeffs.select(F.posexplode("coeff").alias("parent", "value")).groupBy("parent").agg(F.avg("value").alias("m"))
    total = mean.agg(F.greatest(F.sum("m"), F.lit(1e-12)).alias("t")).scalar()
    return mean.select("parent", (F.col("m") / total).alias("usage"))


def usage_summary(usage: DataFrame) -> DataFrame:
    """Balance against uniform, normalised entropy, min and max of parent usage."""
    p = F.greatest("usage", F.lit(1e-12))
    return usage.agg(
        F.count("*").alias("n"),
        F.sum("usage").alias("s"),
        F.sum(F.pow("usage", F.lit(2.0))).alias("sq"),
        (-F.sum(F.col("usage") * F.log(p))).alias("h"),
        F.min("usage").alias("usage_min"),
        F.max("usage").alias("usage_max"),
    ).select(
        # mean of (usage - 1/n)^2 expanded
        ((F.col("sq") - 2 * F.col("s") / F.col("n") + 1 / F.col("n")) / F.col("n")).alias("balance_mse"),
        (F.col("h") / F.log(F.greatest(F.col("n"), F.lit(2)).cast("double"))).alias("entropy"),
        "usage_min",
        "usage_max",
    )


def percentile_clamp(hits: DataFrame, sampled: DataFrame, q: float, latent_dim: int) -> DataFrame:
    """Per-latent percentile of the dense activations of the ``sampled`` tiles (G17), by rank selection.

    ``sampled`` holds tile keys, of a sample or of all tiles, and ``hits`` the non-zero activations of those tiles; ``hits`` is read once per
    round. Each latent adds one zero row weighted by its missing tiles, so zeros are never written out.
    """
    n = sampled.agg(F.count("*").alias("n")).scalar()
    nnz = hits.groupBy("latent_idx").agg(F.count("*").alias("nnz"))
    dims = hits.sparkSession.range(latent_dim).select(F.col("id").alias("latent_idx"))
    zeros = settle(
        dims.join(nnz, "latent_idx", "left")
        .select("latent_idx", F.lit(0.0).alias("z"), (n - F.coalesce("nnz", F.lit(0))).alias("freq"))
        .where("freq > 0")
    )
    values = hits.select("latent_idx", F.col("z").cast("double").alias("z"), F.lit(1).cast("long").alias("freq")).unionByName(zeros)
    return percentiles(values, q, "latent_idx").withColumnRenamed("value", "clamp_value")


def reject_summary(rejected: DataFrame) -> DataFrame:
    """Rejected rows counted by reason, most frequent first."""
    return rejected.groupBy("reason").agg(F.count("*").alias("rejected")).orderBy(F.col("rejected").desc(), "reason")
