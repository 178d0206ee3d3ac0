"""Latent selection: top by a statistic, manual, or balanced over parents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCORE = {"top_activation": "z_max", "top_variance": "variance", "top_sparsity": "sparsity"}


def select_latents(
    stats: DataFrame,
    strategy: str,
    n: int,
    manual: list[int] | None = None,
    parents: DataFrame | None = None,
    max_children: int = 6,
    preferred: int = 4,
    target: int | None = None,
) -> DataFrame:
    """``(sel_pos, latent_idx)`` in selection order, one of the five strategies (H1-H3)."""
    if n <= 0:
        raise ValueError("n must be positive")
    if strategy == "manual":
        if not manual:
            raise ValueError("manual selection needs latent ids")
        spark = stats.sparkSession
        return spark.createDataFrame([(i + 1, int(v)) for i, v in enumerate(manual)], "sel_pos int, latent_idx bigint")
    if strategy == "sdf_parent_balanced":
        if parents is None:
            raise ValueError("sdf_parent_balanced needs a parent per latent")
        return parent_balanced(stats, parents, n, max_children, preferred, target)
    score = F.col(_SCORE[strategy])
    best = stats.orderBy(score.desc_nulls_last(), F.col("latent_idx").desc()).limit(n)
    order = Window.orderBy(score.desc_nulls_last(), F.col("latent_idx").desc())
    return best.select(F.row_number().over(order).alias("sel_pos"), "latent_idx", score.alias("score"))


def parent_balanced(
    stats: DataFrame, parents: DataFrame, n: int, max_children: int = 6, preferred: int = 4, target: int | None = None
) -> DataFrame:
    """Seed one child per target parent, then add children by score minus a per-child penalty (H3).

    The greedy loop "take the best next child over all parents" merges the
    parents' child lists. Merging by head is the same as one sort on the running
    minimum of the list keys, so the whole rule is windows plus a sort. All
    inputs hold one row per latent.
    """
    max_children = max(1, max_children)
    preferred = min(max(1, preferred), max_children)
    target = max(1, target if target and target > 0 else math.ceil(n / preferred))

    table = stats.select("latent_idx", F.coalesce("z_max", F.lit(float("-inf"))).alias("score"))
    table = table.join(parents.select("latent_idx", "parent"), "latent_idx")
    in_parent = Window.partitionBy("parent").orderBy(F.col("score").desc(), "latent_idx")
    ranked = table.withColumn("child", F.row_number().over(in_parent) - 1)
    heads = ranked.where("child = 0").select("parent", F.col("score").alias("best"))
    heads = heads.withColumn("parent_rank", F.row_number().over(Window.orderBy(F.col("best").desc(), "parent")))
    middle = heads.where(F.col("parent_rank") <= target).agg(F.percentile("best", 0.5).alias("m")).scalar()
    penalty = middle / float(max(2, 2 * preferred))

    pool = ranked.where(F.col("child") < max_children).join(heads.select("parent", "parent_rank"), "parent")
    pool = pool.withColumn("utility", F.col("score") - penalty * F.col("child"))
    grown = Window.partitionBy("parent").orderBy("child").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct("utility", "score", (-F.col("child")).alias("c"), (-F.col("parent")).alias("p"))
    pool = pool.withColumn("merge_key", F.min(F.when(F.col("child") > 0, key)).over(grown))
    phase = F.when(F.col("parent_rank") <= target, 0).otherwise(1)
    seed = F.when(F.col("child") == 0, F.col("parent_rank"))
    turn = Window.orderBy(
        phase, F.when(F.col("child") == 0, 0).otherwise(1), seed, F.col("merge_key").desc_nulls_last(), "parent", "child"
    )
    taken = pool.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n)
    final = Window.orderBy("parent_rank", "child")
    return taken.select(F.row_number().over(final).alias("sel_pos"), "latent_idx", "score", "parent", "parent_rank", "child")


def hierarchy(parents: DataFrame, selected: DataFrame) -> DataFrame:
    """Per parent: number of latents, and its selected latents in selection order."""
    counts = parents.groupBy("parent").agg(F.count("*").alias("child_count"))
    # a selection is at most n latents, so each list is short
    chosen = (
        selected.select("sel_pos", "latent_idx")
        .join(parents.select("latent_idx", "parent"), "latent_idx")
        .groupBy("parent")
        .agg(F.sort_array(F.collect_list(F.struct("sel_pos", "latent_idx"))).alias("s"))
        .select("parent", F.transform("s", lambda x: x["latent_idx"]).alias("selected_children"))
    )
    empty = F.array().cast("array<bigint>")
    return counts.join(chosen, "parent", "left").select(
        "parent", "child_count", F.coalesce("selected_children", empty).alias("selected_children")
    )


def selected_map(selected: DataFrame) -> DataFrame:
    """``(latent_idx, selected_strategies)``: sorted, comma-joined strategy names."""
    names = F.concat_ws(",", F.sort_array(F.collect_set("latent_strategy")))
    return selected.groupBy("latent_idx").agg(names.alias("selected_strategies"))


def selected_union(selected: DataFrame) -> DataFrame:
    """Distinct latents over all strategies (K3)."""
    return selected.select("latent_idx").distinct()


def latent_order(df: DataFrame, selected: DataFrame) -> DataFrame:
    """Add ``out_pos``: selected latents in selection order, then the rest ascending."""
    present = df.select("latent_idx").distinct().join(selected.select("latent_idx", "sel_pos"), "latent_idx", "left")
    order = Window.orderBy(F.col("sel_pos").asc_nulls_last(), "latent_idx")
    return df.join(present.select("latent_idx", F.row_number().over(order).alias("out_pos")), "latent_idx")
