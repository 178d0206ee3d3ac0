"""Row filters and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.runtime import attach_small, settle


def require_features(slides: DataFrame, features: DataFrame, key: str = "slide_key") -> DataFrame:
    """Slides that have a feature row."""
    return slides.join(features.select(key).distinct(), key, "left_semi")


def drop_empty(slides: DataFrame, counts: DataFrame, fail_if_none: bool = True) -> DataFrame:
    """Slides with at least one usable tile."""
    usable = counts.where("n_usable > 0")
    if fail_if_none and usable.isEmpty():
        raise ValueError("no usable slides remain")
    return slides.join(usable.select("slide_key"), "slide_key", "left_semi")


def positive_only(acts: DataFrame) -> DataFrame:
    return acts.where(F.col("z") > 0)


def keep_latents(acts: DataFrame, selected: DataFrame) -> DataFrame:
    """Activations of the selected latents; the selection is broadcast once its size is known (C4)."""
    wanted = selected.select("latent_idx").distinct()
    return acts.join(attach_small(wanted), "latent_idx", "left_semi")


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First n rows in a fixed order (debug limit, C5); n <= 0 keeps all."""
    return df if n <= 0 else df.orderBy(*order).limit(n)


def first_n(top_tiles: DataFrame, n: int) -> DataFrame:
    return top_tiles if n <= 0 else top_tiles.where(F.col("source_rank") <= n)


def binary_label(label: Column | str, positive: str = "HPV+", negative: str = "HPV-") -> Column:
    """1, 0 or null for a trimmed, case-folded label."""
    value = F.upper(F.trim(F.col(label) if isinstance(label, str) else label))
    return F.when(value == positive.upper(), 1).when(value == negative.upper(), 0)


def isolate_slides(tiles: DataFrame, d_in: int) -> tuple[DataFrame, DataFrame]:
    """(tiles of sound slides, rejected slides with a reason) for slides with a vector that cannot be encoded or a tile without a place."""
    vec = F.col("features")
    bad_value = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    verdict = tiles.groupBy("slide_key").agg(
        F.max(vec.isNull()).alias("none"), F.max(vec.isNotNull() & (F.size(vec) != d_in)).alias("width"),
        F.max(F.coalesce(bad_value, F.lit(False))).alias("value"), F.max(F.col("coord_x").isNull() | F.col("coord_y").isNull()).alias("place"),
    )
    reason = (
        F.when(F.col("none"), "null_features").when(F.col("width"), "bad_feature_shape")
        .when(F.col("value"), "non_finite_value").when(F.col("place"), "bad_geometry")
    )
    rejected = settle(verdict.select("slide_key", reason.alias("reason")).where("reason is not null"))
    return tiles.join(attach_small(rejected.select("slide_key")), "slide_key", "left_anti"), rejected


def rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Split into kept and rejected rows; the first rule that holds names the reason."""
    reason = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")
