"""Support rows, their four rankings, representatives and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake import schemas
from latentlake.functions import ids

GROUP = ("latent_strategy", "latent_idx")
_RUN_DEFAULTS = {"run_name": "", "stage": "relu", "dataset": "TCGA", "encoder": "", "data_split": ""}


def support_rows(top: DataFrame, slides: DataFrame, run: dict[str, str] | None = None, root: str = "/") -> DataFrame:
    """Top tiles with ids, cohort and feature path attached.

    ``top`` carries (latent_strategy, latent_idx, latent_group, source_rank,
    slide_key, tile_index, coord_x, coord_y, z); ``slides`` carries
    (slide_key, case_id, cohort, feature_path).
    """
    facts = {**_RUN_DEFAULTS, **(run or {})}
    path = F.coalesce("feature_path", F.lit(""))
    dims = slides.select("slide_key", "case_id", "cohort", "feature_path")
    rows = top.join(dims, "slide_key", "left")
    return rows.select(
        *[F.lit(v).alias(k) for k, v in facts.items()],
        *GROUP,
        "latent_group",
        F.lit("").alias("representative_method"),
        F.lit("support").alias("row_kind"),
        F.lit(0).alias("method_rank"),
        "source_rank",
        F.coalesce("case_id", ids.case_id("slide_key")).alias("case_id"),
        "slide_key",
        F.coalesce("cohort", F.lit("")).alias("cohort"),
        "tile_index",
        "coord_x",
        "coord_y",
        ids.feature_relpath(path, root).alias("feature_relpath"),
        ids.path_name(path).alias("feature_h5_name"),
        path.alias("legacy_h5_path"),
        F.col("z").alias("activation"),
        F.col("z").alias("method_score"),
    )


def slide_support_stats(support: DataFrame) -> DataFrame:
    """Count, max and mean activation of each slide inside a latent's support."""
    group = Window.partitionBy(*GROUP, "slide_key")
    return (
        support.withColumn("slide_support_count", F.count("*").over(group))
        .withColumn("slide_max_activation", F.max("activation").over(group))
        .withColumn("slide_mean_activation", F.avg("activation").over(group))
    )


def attach_global_stats(support: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the latent's global max, variance and sparsity."""
    dims = stats.select(
        "latent_idx",
        F.col("z_max").alias("max_activation_global"),
        F.col("variance").alias("variance_global"),
        F.col("sparsity").alias("sparsity_score_global"),
    )
    return support.join(dims, "latent_idx", "left").fillna(
        0.0, ["max_activation_global", "variance_global", "sparsity_score_global"]
    )


def rank_support(support: DataFrame, methods: tuple[str, ...] = schemas.REPRESENTATIVE_METHODS) -> DataFrame:
    """Every support row once per method with ``method_rank`` and ``method_score``.

    Needs the slide_support_stats columns. Rows are replicated once per method
    and ranked by one window, so the support is shuffled a single time.
    """
    unknown = set(methods) - set(schemas.REPRESENTATIVE_METHODS)
    if unknown:
        raise ValueError(f"unknown representative methods: {sorted(unknown)}")
    act, latent = F.col("activation"), Window.partitionBy(*GROUP)
    in_slide = Window.partitionBy(*GROUP, "slide_key").orderBy(act.desc(), "source_rank")
    base = support.withColumn("_gap", F.abs(act - F.percentile("activation", 0.5).over(latent)))
    base = base.withColumn("_later", (F.row_number().over(in_slide) > 1).cast("int"))
    copies = base.withColumn("representative_method", F.explode(F.array(*[F.lit(m) for m in methods])))
    method = F.col("representative_method")
    spread, median = method == "slide_spread", method == "median_activation"
    count, peak, avg = (F.col(c) for c in ("slide_support_count", "slide_max_activation", "slide_mean_activation"))
    order = Window.partitionBy(*GROUP, "representative_method").orderBy(
        F.when(spread, -count),
        F.when(spread, -peak),
        F.when(spread, -avg),
        F.when(spread, F.col("slide_key")),
        # an even support has two rows at equal distance; rounding keeps that a tie
        F.when(median, F.round("_gap", 9)),
        F.when(method == "diverse_support", F.col("_later")),
        act.desc(),
        "source_rank",
        "slide_key",
    )
    score = (
        F.when(spread, count * 1_000_000.0 + peak * 1_000.0 + avg).when(median, -F.col("_gap")).otherwise(act)
    )
    return (
        copies.withColumn("method_rank", F.row_number().over(order))
        .withColumn("method_score", score)
        .withColumn("row_kind", F.lit("support"))
        .drop("_gap", "_later")
    )


def representatives(ranked: DataFrame) -> DataFrame:
    """First row of each (strategy, latent, method)."""
    return ranked.where("method_rank = 1").withColumn("row_kind", F.lit("representative"))


def latent_summary(support: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per strategy and latent over its support."""
    run = [c for c in ("run_name", "stage", "dataset", "encoder", "data_split") if c in support.columns]
    act = F.col("activation")
    # support is a top list: at most topn values per group enter the percentiles
    summary = support.groupBy(*run, *GROUP, "latent_group").agg(
        F.count("*").alias("support_tile_count"),
        F.count_distinct("slide_key").alias("unique_slide_count"),
        F.count_distinct("case_id").alias("unique_case_count"),
        F.max(act).alias("activation_max"),
        F.avg(act).alias("activation_mean"),
        F.percentile(act, 0.5).alias("activation_p50"),
        F.percentile(act, 0.9).alias("activation_p90"),
    )
    return attach_global_stats(summary, stats)


def bundle_summary(
    reps: DataFrame, support: DataFrame, summary: DataFrame, run: dict[str, str] | None = None, selection_split: str = "",
    export_split: str = "", strategies: tuple[str, ...] | None = None,
) -> DataFrame:
    """Global counts over the (method-replicated) support table.

    With ``run`` (run_name, stage, dataset, encoder) the row also names the run, both splits, the latent strategies (those of ``summary`` unless
    given, in their order) and the representative methods found.
    """
    filled = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    out = support.agg(
        filled("slide_key").alias("total_slides"),
        filled("case_id").alias("total_cases"),
        filled("feature_relpath").alias("total_feature_files"),
        F.count("*").alias("total_support_rows"),
        F.coalesce(F.max("activation"), F.lit(0.0)).alias("max_activation"),
        F.coalesce(F.avg("activation"), F.lit(0.0)).alias("mean_activation"),
    ).select(
        summary.agg(F.count("*").alias("n")).scalar().alias("total_latent_rows"),
        reps.agg(F.count("*").alias("n")).scalar().alias("total_representative_rows"),
        "*",
    )
    if run is None:
        return out
    # a handful of names each
    named = lambda df, c: df.agg(F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias("v")).scalar()
    facts = {k: F.lit(run.get(k, "")) for k in ("run_name", "stage", "dataset", "encoder")}
    facts |= {"selection_split": F.lit(selection_split), "export_split": F.lit(export_split)}
    facts["available_latent_strategies"] = named(summary, "latent_strategy") if strategies is None else F.array(*map(F.lit, strategies))
    facts["available_representative_methods"] = named(reps, "representative_method")
    return out.select(*(v.alias(k) for k, v in facts.items()), "*")


# --- viewer tables ------------------------------------------------------------------------


def viewer_rows(top: DataFrame, slides: DataFrame, run: dict[str, str] | None = None) -> DataFrame:
    """Prototype table of the viewer: rank by score within each latent."""
    facts = {k: v for k, v in {**_RUN_DEFAULTS, **(run or {})}.items() if k != "stage"}
    order = Window.partitionBy("latent_idx").orderBy(F.col("z").desc(), "source_rank")
    rows = top.withColumn("prototype_rank", F.row_number().over(order))
    rows = rows.join(slides.select("slide_key", "case_id", "feature_path"), "slide_key", "left")
    group = F.col("latent_group") if "latent_group" in top.columns else F.lit("selected")
    return rows.select(
        "latent_idx",
        group.alias("latent_group"),
        "prototype_rank",
        F.col("z").alias("activation"),
        F.lit(0.0).alias("attention"),
        *[F.lit("").alias(c) for c in ("label", "pred", "prob_pos")],
        F.coalesce("case_id", ids.case_id("slide_key")).alias("case_id"),
        "slide_key",
        "tile_index",
        "coord_x",
        "coord_y",
        F.coalesce("feature_path", F.lit("")).alias("h5_path"),
        *[F.lit(facts[k]).alias(k) for k in ("dataset", "encoder", "data_split", "run_name")],
        F.col("z").alias("score"),
    )


def viewer_latent_summary(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Per latent: best tile, tile and slide counts, global statistics."""
    best = F.min_by(
        F.struct("activation", "slide_key", "case_id", "tile_index", "coord_x", "coord_y"), F.col("prototype_rank")
    )
    table = rows.groupBy("latent_idx", "latent_group").agg(
        F.count("*").alias("top_tile_count"),
        F.count_distinct("slide_key").alias("unique_slide_count"),
        best.alias("b"),
    )
    names = ("activation", "slide_key", "case_id", "tile_index", "coord_x", "coord_y")
    flat = table.select("*", *[F.col(f"b.{n}").alias(f"best_{n}") for n in names]).drop("b")
    return attach_global_stats(flat, stats)


def viewer_bundle_summary(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Global counts of the viewer tables."""
    return rows.agg(
        F.count_distinct("latent_idx").alias("latent_rows_count"),
        F.count("*").alias("prototype_rows_count"),
        F.count_distinct(F.nullif("slide_key", F.lit(""))).alias("slides_count"),
        F.coalesce(F.max("activation"), F.lit(0.0)).alias("max_activation"),
        F.coalesce(F.avg("activation"), F.lit(0.0)).alias("mean_activation"),
    ).withColumn("selected_latents_count", selected.agg(F.count("*").alias("n")).scalar())
