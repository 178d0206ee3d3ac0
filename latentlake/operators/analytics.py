"""Prevalence, enrichment and histograms from per-(slide, latent) statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake import schemas
from latentlake.functions import ids
from latentlake.runtime import attach_small, every_pair


def _total(df: DataFrame, expr=None):
    return df.agg((expr if expr is not None else F.count("*")).alias("n")).scalar()


def _present(cohort: str = "cohort"):
    return F.nullif(F.coalesce(F.col(cohort), F.lit("")), F.lit(""))


def slide_latent_stats(partials: DataFrame, slides: DataFrame, counts: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of every non-empty slide for every selected latent, zeros included.

    ``selected`` is (latent_strategy, latent_idx, latent_group).
    """
    used = slides.select("slide_key", "case_id", "cohort").join(
        counts.where("total_tiles > 0").select("slide_key", "total_tiles"), "slide_key"
    )
    skeleton = every_pair(used, selected.select("latent_strategy", "latent_idx", "latent_group"))
    own = partials.join(attach_small(selected.select("latent_idx").distinct()), "latent_idx", "left_semi")
    joined = skeleton.join(own, ["slide_key", "latent_idx"], "left")
    pos = F.coalesce("pos_n", F.lit(0))
    peak = F.greatest(F.coalesce("z_max", F.lit(0.0)), F.lit(0.0))
    return joined.select(
        "latent_strategy",
        "latent_idx",
        "latent_group",
        "case_id",
        "slide_key",
        F.coalesce("cohort", F.lit("")).alias("cohort"),
        peak.alias("slide_max_activation"),
        F.when(pos > 0, F.col("pos_sum") / pos).otherwise(0.0).alias("slide_mean_positive_activation"),
        pos.alias("positive_tile_count"),
        F.col("total_tiles").alias("total_tiles_seen"),
        (peak > 0).cast("int").alias("fires"),
    )


def firing_slides(partials: DataFrame, slides: DataFrame) -> DataFrame:
    """(latent_idx, slide_key, case_id, cohort) of every slide with a positive activation."""
    firing = partials.where("pos_n > 0").select("slide_key", "latent_idx")
    return firing.join(attach_small(slides.select("slide_key", "case_id", "cohort")), "slide_key")


def prevalence(firing: DataFrame, slides: DataFrame) -> DataFrame:
    """Share of all slides and of all cases in which a latent fires."""
    total = slides.agg(
        F.greatest(F.count("*"), F.lit(1)).alias("s"), F.greatest(F.count_distinct("case_id"), F.lit(1)).alias("c")
    )
    # slides first collapse into cases, so no distinct set is held per latent
    per_case = firing.groupBy("latent_idx", "case_id").agg(F.count("*").alias("n"))
    return per_case.groupBy("latent_idx").agg(
        F.sum("n").alias("slides_with_activation"), F.count("*").alias("cases_with_activation")
    ).select(
        "latent_idx",
        "slides_with_activation",
        "cases_with_activation",
        (F.col("slides_with_activation") / total.select("s").scalar()).alias("slide_prevalence"),
        (F.col("cases_with_activation") / total.select("c").scalar()).alias("case_prevalence"),
    )


def cohort_counts(firing: DataFrame) -> DataFrame:
    """Firing slides per (latent, cohort), blank cohorts left out."""
    return firing.where(_present().isNotNull()).groupBy("latent_idx", "cohort").agg(F.count("*").alias("firing_slides"))


def cohort_spread(firing: DataFrame) -> DataFrame:
    """Cohort entropy, top cohort and its share of all firing slides."""
    counts = cohort_counts(firing)
    n, c = F.col("n"), F.col("firing_slides").cast("double")
    # -sum(p ln p) = ln n - sum(c ln c) / n
    per_latent = counts.groupBy("latent_idx").agg(
        F.sum("firing_slides").alias("n"),
        F.sum(c * F.log(c)).alias("clogc"),
        F.min(F.struct((-F.col("firing_slides")).alias("neg"), F.col("cohort").alias("cohort"))).alias("top"),
    )
    every = firing.groupBy("latent_idx").agg(F.count("*").alias("all_slides"))
    return per_latent.join(every, "latent_idx").select(
        "latent_idx",
        F.greatest(F.log(n.cast("double")) - F.col("clogc") / n, F.lit(0.0)).alias("cohort_entropy"),
        F.col("top.cohort").alias("top_cohort"),
        (-F.col("top.neg") / F.col("all_slides")).alias("top_cohort_share"),
    )


def latent_metrics(
    partials: DataFrame, stats: DataFrame, slides: DataFrame, selected: DataFrame | None, latent_dim: int
) -> DataFrame:
    """All-latent metrics, one row per latent in ``[0, latent_dim)``.

    ``partials`` are dense per-slide partials; ``stats`` are finalised dense
    latent statistics over the same tiles.
    """
    from latentlake.operators.selection import selected_map

    spark = partials.sparkSession
    dims = spark.range(latent_dim).select(F.col("id").alias("latent_idx"))
    firing = firing_slides(partials, slides)
    positive = partials.groupBy("latent_idx").agg(
        F.sum("pos_n").alias("pos_n"), F.sum("pos_sum").alias("pos_sum"), F.max("z_max").alias("seen")
    )
    out = (
        dims.join(stats.select("latent_idx", "z_max", "variance", "sparsity"), "latent_idx", "left")
        .join(positive, "latent_idx", "left")
        .join(prevalence(firing, slides), "latent_idx", "left")
        .join(cohort_spread(firing), "latent_idx", "left")
    )
    if selected is not None:
        out = out.join(selected_map(selected), "latent_idx", "left")
    else:
        out = out.withColumn("selected_strategies", F.lit(""))
    seen = F.greatest(F.coalesce("seen", F.lit(0.0)), F.lit(0.0))
    pos = F.coalesce("pos_n", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(
        "latent_idx",
        (seen > 0).cast("int").alias("is_alive"),
        F.coalesce("selected_strategies", F.lit("")).alias("selected_strategies"),
        F.coalesce("z_max", F.lit(0.0)).alias("max_activation_global"),
        F.coalesce("variance", F.lit(0.0)).alias("variance_global"),
        F.coalesce("sparsity", F.lit(1.0)).alias("sparsity_score_global"),
        zero("slide_prevalence"),
        zero("case_prevalence"),
        pos.alias("num_tiles_positive"),
        F.when(pos > 0, F.col("pos_sum") / pos).otherwise(0.0).alias("mean_positive_activation"),
        seen.alias("max_activation_seen"),
        zero("cohort_entropy"),
        F.coalesce("top_cohort", F.lit("")).alias("top_cohort"),
        zero("top_cohort_share"),
    )


def cohort_enrichment(firing: DataFrame, slides: DataFrame, selected: DataFrame) -> DataFrame:
    """Prevalence in each cohort over global prevalence, zero-filled."""
    cohorts = slides.where(_present().isNotNull())
    sizes = cohorts.groupBy("cohort").agg(F.count("*").alias("slides_in_cohort"))
    total = _total(slides, F.greatest(F.count("*"), F.lit(1)))
    wanted = selected.select("latent_strategy", "latent_idx", "latent_group")
    own = firing.join(attach_small(wanted.select("latent_idx").distinct()), "latent_idx", "left_semi")
    overall = own.groupBy("latent_idx").agg(F.count("*").alias("firing_all"))
    out = (
        every_pair(wanted, cohorts.select("cohort"))
        .join(sizes, "cohort")
        .join(cohort_counts(own), ["latent_idx", "cohort"], "left")
        .join(overall, "latent_idx", "left")
    )
    hit = F.coalesce("firing_slides", F.lit(0))
    inside = hit / F.col("slides_in_cohort")
    overall_prev = F.coalesce("firing_all", F.lit(0)) / total
    return out.select(
        "latent_strategy",
        "latent_idx",
        "latent_group",
        "cohort",
        "slides_in_cohort",
        hit.alias("slides_with_activation"),
        inside.alias("prevalence_in_cohort"),
        overall_prev.alias("prevalence_global"),
        F.when(overall_prev > 0, F.try_divide(inside, overall_prev)).otherwise(0.0).alias("enrichment_ratio"),
    )


def case_scores(slide_stats: DataFrame) -> DataFrame:
    """Best slide maximum per (strategy, latent, case) and whether the case fires."""
    scores = slide_stats.groupBy("latent_strategy", "latent_idx", "latent_group", "case_id").agg(
        F.max("slide_max_activation").alias("case_score")
    )
    return scores.withColumn("fires", (F.col("case_score") > 0).cast("int"))


def case_labels(labels: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """``(case_id, label_column, label_value)``: the last row of a case wins (Q12 of the survey)."""
    keyed = labels.withColumn("case_id", ids.case_id("case_id")).where("case_id <> ''")
    latest = keyed.groupBy("case_id").agg(
        *[F.max_by(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(ordinal)).alias(c) for c in columns]
    )
    return latest.unpivot("case_id", columns, "label_column", "label_value")


def label_enrichment(slide_stats: DataFrame, slides: DataFrame, long_labels: DataFrame, selected: DataFrame) -> DataFrame:
    """Case prevalence per label value over prevalence among all labelled cases."""
    cases = slides.select("case_id").distinct()
    labelled = long_labels.join(cases, "case_id", "left_semi")
    overall = labelled.groupBy("label_column").agg(F.count("*").alias("labelled"))
    sizes = labelled.where("label_value <> ''").groupBy("label_column", "label_value").agg(
        F.count("*").alias("cases_in_label")
    )
    fired = case_scores(slide_stats).where("fires = 1").select("latent_strategy", "latent_idx", "case_id")
    hits = fired.join(labelled, "case_id").groupBy("latent_strategy", "latent_idx", "label_column", "label_value").agg(
        F.count("*").alias("n")
    )
    totals = hits.groupBy("latent_strategy", "latent_idx", "label_column").agg(F.sum("n").alias("n_all"))
    out = (
        every_pair(selected.select("latent_strategy", "latent_idx", "latent_group"), sizes.select("label_column", "label_value"))
        .join(sizes, ["label_column", "label_value"])
        .join(overall, "label_column")
        .join(hits, ["latent_strategy", "latent_idx", "label_column", "label_value"], "left")
        .join(totals, ["latent_strategy", "latent_idx", "label_column"], "left")
    )
    hit = F.coalesce("n", F.lit(0))
    inside = hit / F.col("cases_in_label")
    overall_prev = F.coalesce("n_all", F.lit(0)) / F.col("labelled")
    return out.select(
        "latent_strategy",
        "latent_idx",
        "latent_group",
        "label_column",
        "label_value",
        "cases_in_label",
        hit.alias("cases_with_activation"),
        inside.alias("prevalence_in_label"),
        overall_prev.alias("prevalence_global"),
        F.when(overall_prev > 0, F.try_divide(inside, overall_prev)).otherwise(0.0).alias("enrichment_ratio"),
    )


def histogram_bins(slide_stats: DataFrame, bins: int = 32) -> DataFrame:
    """Counts per equal bin on [0, max]; empty bins present, last bin closed.

    Slides are first combined per (group, bin), so a latent's slides never meet
    in one list.
    """
    keys = ["latent_strategy", "latent_idx", "latent_group"]
    peak = F.max("slide_max_activation")
    groups = slide_stats.groupBy(*keys).agg(
        peak.alias("max_activation"),
        F.count("*").alias("n_slides"),
        F.sum("fires").cast("bigint").alias("n_firing_slides"),
    )
    groups = groups.withColumn("upper", F.when(F.col("max_activation") > 0, F.col("max_activation")).otherwise(1.0))
    value = F.col("slide_max_activation")
    slot = F.least(F.width_bucket(value, F.lit(0.0), F.col("upper"), F.lit(bins)), F.lit(bins)) - 1
    counts = (
        slide_stats.join(groups.select(*keys, "upper"), keys)
        .groupBy(*keys, slot.cast("int").alias("bin"))
        .agg(F.count("*").alias("slides"))
    )
    every = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = F.col("upper") / bins
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("bin") * width).alias("bin_lo"),
        ((F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("slides", F.lit(0)).alias("slides"),
        "n_slides",
        "n_firing_slides",
        "max_activation",
    )


def histograms(slide_stats: DataFrame, bins: int = 32) -> DataFrame:
    """One row per strategy and latent with ``bin_edges`` and ``counts`` arrays of ``bins`` entries."""
    rows = histogram_bins(slide_stats, bins)
    keys = ["latent_strategy", "latent_idx", "latent_group", "n_slides", "n_firing_slides", "max_activation"]
    ordered = F.sort_array(F.collect_list(F.struct("bin", "bin_lo", "bin_hi", "slides")))
    packed = rows.groupBy(*keys).agg(ordered.alias("b"))
    edges = F.concat(
        F.transform("b", lambda x: x["bin_lo"]), F.array(F.element_at("b", F.lit(-1))["bin_hi"])
    )
    return packed.select(*keys, edges.alias("bin_edges"), F.transform("b", lambda x: x["slides"]).alias("counts"))


