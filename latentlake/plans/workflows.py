"""Mining, representative export, analytics, bundles, probe and viewer tables as one call each.

Every function returns a dict of DataFrames. Expensive steps (an encode pass over
all tiles) are written once with settle() when several outputs read them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake import schemas
from latentlake.functions import ids
from latentlake.operators import (
    analytics,
    encode,
    filters,
    materialize,
    mining,
    pooling,
    probe,
    prototypes,
    ranking,
    registry,
    resolve,
    sampling,
    selection,
    stats,
)
from latentlake.operators.encode import LatentModel
from latentlake.runtime import attach_small, settle
from latentlake.sources import writers

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class MineConfig:
    """Options shared by the mining workflows; defaults follow the published settings."""

    strategies: tuple[str, ...] = ("top_activation",)
    n_latents: int = 128
    topn: int = 50
    buffer_factor: float = 4.0
    per_slide: int = 3
    min_px: int = 512
    tiles_per_slide: int = 2048
    slides_per_project: int | None = None
    magnification: str = "20x"
    require_complete: bool = True
    max_children: int = 6
    preferred_children: int = 4
    target_parents: int | None = None
    seed: int = 1337


#: Options of the bundle workflows (P2, P4): at most 200 slides of a project.
BUNDLE_CONFIG = MineConfig(slides_per_project=200)

_PASS2 = 17  # seed distance between the two passes


def view_tiles(tiles: DataFrame, slides: DataFrame, cfg: MineConfig, d_in: int) -> tuple[DataFrame, DataFrame]:
    """(tiles of the slides, capped per cohort and pooled if asked; rejected slides with reasons).

    A slide that cannot be encoded is left out and reported; it does not end the run.
    """
    if cfg.slides_per_project is not None:
        named = slides.select("slide_key", F.col("cohort").alias("project"))
        kept = sampling.cap_slides(named, cfg.slides_per_project, cfg.seed).select("slide_key")
    else:
        kept = slides.select("slide_key").distinct()
    tiles = tiles.join(attach_small(kept), "slide_key", "left_semi")
    tiles, rejected = filters.isolate_slides(tiles, d_in)
    if cfg.magnification == "10x_pool2x2":
        rejected = settle(rejected.unionByName(pooling.geometry_rejects(tiles)))
        tiles = settle(pooling.pool2x2(tiles, cfg.require_complete))
    return tiles.select("slide_key", "tile_index", "coord_x", "coord_y", "features"), rejected


def _select_all(st: DataFrame, cfg: MineConfig, parents: DataFrame | None) -> DataFrame:
    """Selections of all strategies with groups; strategies that need parents are skipped without them."""
    parts = []
    for strategy in cfg.strategies:
        if strategy == "sdf_parent_balanced" and parents is None:
            continue
        chosen = selection.select_latents(
            st, strategy, cfg.n_latents, parents=parents, max_children=cfg.max_children,
            preferred=cfg.preferred_children, target=cfg.target_parents,
        )
        parts.append(chosen.select(F.lit(strategy).alias("latent_strategy"), "sel_pos", "latent_idx"))
    return ids.latent_group(reduce(DataFrame.unionByName, parts), parents)


def latent_statistics(tiles: DataFrame, model: LatentModel) -> DataFrame:
    """Finalised statistics, written once; refuses to go on when no latent has a finite maximum."""
    st = settle(stats.finalize_stats(encode.encode_stats(tiles, model)))
    if st.where("z_max is not null").isEmpty():
        raise ValueError("no latent has a finite maximum")
    return st


def mine(tiles: DataFrame, slides: DataFrame, model: LatentModel, cfg: MineConfig, parents: DataFrame | None = None) -> Tables:
    """Statistics, selection, diverse top tiles and hierarchy over one slide set."""
    view, rejected = view_tiles(tiles, slides, cfg, model.shape()[1])
    st = latent_statistics(sampling.cap_tiles(view, cfg.tiles_per_slide, cfg.seed, "pass1"), model)
    selected = settle(_select_all(st, cfg, parents))
    candidates = mining.overfetch(cfg.topn, cfg.buffer_factor if cfg.per_slide > 0 or cfg.min_px > 0 else 1.0)
    source = sampling.cap_tiles(view, cfg.tiles_per_slide, cfg.seed + _PASS2, "pass2")
    top = settle(encode.encode_top(source, model, candidates, selection.selected_union(selected)))
    out = {
        "stats": st,
        "selected": selected,
        "candidates": top,
        "top_tiles": mining.diversify(top, cfg.topn, cfg.per_slide, cfg.min_px),
        "rejects": rejected,
    }
    if parents is not None:
        out["hierarchy"] = selection.hierarchy(parents, selected.dropDuplicates(["latent_idx"]))
    return out


def representatives_bundle(
    tiles: DataFrame, slides: DataFrame, model: LatentModel, cfg: MineConfig, run: dict[str, str],
    parents: DataFrame | None = None, selection_split: str = "train", export_split: str = "test", root: str = "/",
) -> Tables:
    """Select on one split, mine another, rank four ways.

    All strategies share one encode pass over the union of their latents. Slides of the exported split are drawn with a seed of their own.
    ``BUNDLE_CONFIG`` has the published options.
    """
    d_in = model.shape()[1]
    chosen, rejected = view_tiles(tiles, slides.where(F.col("split") == selection_split), cfg, d_in)
    st = latent_statistics(sampling.cap_tiles(chosen, cfg.tiles_per_slide, cfg.seed, "pass1"), model)
    selected = settle(_select_all(st, cfg, parents))
    exported = slides.where(F.col("split") == export_split)
    candidates = mining.overfetch(cfg.topn, cfg.buffer_factor if cfg.per_slide > 0 or cfg.min_px > 0 else 1.0)
    view, more = view_tiles(tiles, exported, replace(cfg, seed=cfg.seed + 1), d_in)
    source = sampling.cap_tiles(view, cfg.tiles_per_slide, cfg.seed + _PASS2, "pass2")
    top = encode.encode_top(source, model, candidates, selection.selected_union(selected))
    top = mining.diversify(top, cfg.topn, cfg.per_slide, cfg.min_px)
    rows = top.join(attach_small(selected.select("latent_strategy", "latent_idx", "latent_group")), "latent_idx")
    base = settle(
        ranking.slide_support_stats(ranking.support_rows(rows, exported, {**run, "data_split": export_split}, root))
    )
    ranked = ranking.attach_global_stats(ranking.rank_support(base), st)
    reps = ranking.representatives(ranked)
    summary = ranking.latent_summary(base, st)
    return {
        "stats": st,
        "selected": selected,
        "representative_latents": reps.select(*schemas.SUPPORT_COLUMNS),
        "representative_support_tiles": ranked.select(*schemas.SUPPORT_COLUMNS),
        "latent_summary": summary.select(*schemas.LATENT_SUMMARY_COLUMNS),
        "bundle_summary": ranking.bundle_summary(reps, ranked, summary, run, selection_split, export_split, cfg.strategies),
        "rejects": rejected.unionByName(more),
    }


def write_bundle(bundle: Tables, folder: str) -> None:
    """CSV tables and a manifest document that read_bundle() understands."""
    writers.write_csv(bundle["representative_latents"], f"{folder}/representative_latents", schemas.SUPPORT_COLUMNS)
    writers.write_csv(bundle["representative_support_tiles"], f"{folder}/representative_support_tiles", schemas.SUPPORT_COLUMNS)
    writers.write_csv(bundle["latent_summary"], f"{folder}/latent_summary", schemas.LATENT_SUMMARY_COLUMNS)
    writers.write_json_doc(bundle["bundle_summary"], f"{folder}/bundle_summary")
    # a manifest lists at most strategies x n_latents ids
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sel_pos", "latent_idx"))), lambda s: s["latent_idx"])
    per = bundle["selected"].groupBy("latent_strategy").agg(F.struct(ordered.alias("selected_latents")).alias("d"))
    detail = F.map_from_entries(F.collect_list(F.struct("latent_strategy", "d")))
    created = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    writers.write_json_doc(
        per.agg(detail.alias("details_by_strategy")).withColumn("created_at", created), f"{folder}/bundle_manifest"
    )


def analytics_tables(
    tiles: DataFrame, slides: DataFrame, model: LatentModel, selected: DataFrame, latent_dim: int,
    labels: DataFrame | None = None, label_columns: list[str] | None = None, ordinal: str = "ord",
    decoder: DataFrame | None = None, bins: int = 32, magnification: str = "20x", require_complete: bool = True,
) -> Tables:
    """All analytics tables of one split from a single per-(slide, latent) pass (P3), in the run's magnification.

    Every model kind is read with plain ReLU here. The partials also give the
    global statistics, so the tiles are encoded exactly once.
    """
    from latentlake.operators.latent_map import latent_map

    dense = model.as_dense()
    used = tiles.join(attach_small(slides.select("slide_key").distinct()), "slide_key", "left_semi")
    rejected = None
    if magnification == "10x_pool2x2":
        rejected = settle(pooling.geometry_rejects(used))
        used = settle(pooling.pool2x2(used, require_complete))
    partials = settle(encode.encode_slide_stats(used, dense))
    counts = settle(stats.count_tiles(used))
    total = counts.agg(F.coalesce(F.sum("total_tiles"), F.lit(0)).alias("n")).scalar()
    st = settle(stats.finalize_stats(stats.stats_from_slides(partials, total, latent_dim)))
    slide_stats = settle(analytics.slide_latent_stats(partials, slides, counts, selected))
    firing = analytics.firing_slides(partials, slides)
    metrics = analytics.latent_metrics(partials, st, slides, selected, latent_dim)
    out = {
        "selected_latent_slide_stats": slide_stats.select(*schemas.SLIDE_STATS_COLUMNS),
        "all_latent_metrics": metrics.select(*schemas.LATENT_METRIC_COLUMNS),
        "cohort_enrichment": analytics.cohort_enrichment(firing, slides, selected),
        "selected_latent_histograms": analytics.histograms(slide_stats, bins),
    }
    if rejected is not None:
        out["rejects"] = rejected
    if labels is not None:
        columns = label_columns or [c for c in labels.columns if c not in ("case_id", ordinal)]
        long = analytics.case_labels(labels, columns, ordinal)
        out["case_label_enrichment"] = analytics.label_enrichment(slide_stats, slides, long, selected)
    if decoder is not None:
        alive = settle(metrics.where("is_alive = 1"))
        placed = latent_map(decoder, alive)
        keep = ["latent_idx", "is_alive", "selected_strategies", "max_activation_global", "variance_global", "sparsity_score_global"]
        out["latent_map"] = placed.join(alive.select(*keep), "latent_idx")
    return out


def mine_bundle(
    tiles: DataFrame, slides: DataFrame, model: LatentModel, cfg: MineConfig, run: dict[str, str],
    parents: DataFrame | None = None, discovery_split: str = "train", export_split: str = "test",
) -> Tables:
    """Discovery and export mining, each with its own selection, then prototypes, targets and viewer tables."""
    part = lambda s: slides.where(F.col("split") == s)
    discovery = mine(tiles, part(discovery_split), model, cfg, parents)
    export = mine(tiles, part(export_split), model, cfg, parents)
    top = settle(export["top_tiles"])
    target = prototypes.targets(top)
    return {
        "discovery_selected": discovery["selected"],
        "selected": export["selected"],
        "top_tiles": top,
        "rejects": discovery["rejects"].unionByName(export["rejects"]),
        "prototypes": prototypes.prototypes(top, tiles, model),
        "prototype_stats": prototypes.prototype_stats(top, tiles, model),
        "targets": target,
        "target_presets": prototypes.target_presets(target),
        **viewer_tables(top, part(export_split), export["stats"], export["selected"], run, parents),
    }


def viewer_tables(
    top: DataFrame, slides: DataFrame, st: DataFrame, selected: DataFrame, run: dict[str, str], parents: DataFrame | None = None
) -> Tables:
    """Prototype rows, latent summary and bundle summary of the viewer."""
    rows = ranking.viewer_rows(ids.latent_group(top, parents), slides, run)
    return {
        "viewer_rows": rows,
        "viewer_latent_summary": ranking.viewer_latent_summary(rows, st),
        "viewer_bundle_summary": ranking.viewer_bundle_summary(rows, selection.selected_union(selected)),
    }


def materialize_bundle(
    reps: DataFrame, support: DataFrame, group: list[str], tiles: DataFrame, mapping: DataFrame, features: DataFrame,
    listing: DataFrame, root: str,
) -> Tables:
    """Bundle rows resolved against the lake, vectors attached, counters (P5)."""
    rows = materialize.bundle_rows(reps, support, group)
    rows = resolve.resolve_features(rows, mapping, features, listing, root)
    rows = settle(resolve.resolve_slides(rows, mapping, listing, root))
    final, vectors = materialize.materialize(rows, tiles)
    return {
        "materialized_rows": final,
        "encoder_features": vectors,
        "materialize_summary": materialize.materialize_summary(final),
    }


def probe_workflow(
    tiles: DataFrame, slides: DataFrame, labels: DataFrame, model: LatentModel, tiles_cap: int = 0, c: float = 1.0,
    penalty: str = "l2", seed: int = 1337, train_split: str = "train",
) -> Tables:
    """Label match, slide features, fitted probe, predictions, metrics and coefficients.

    ``slides`` has slide_key, path and split; ``labels`` has case_id, slide_id, label, ord.
    """
    latent_dim, _ = model.shape()
    matched = settle(probe.match_labels(slides, labels))
    labelled = tiles.join(attach_small(matched.where("y is not null").select("slide_key")), "slide_key", "left_semi")
    used = sampling.cap_tiles(labelled, tiles_cap, seed, "probe")
    data = settle(probe.probe_dataset(encode.encode_slide_stats(used, model), stats.count_tiles(used), matched, latent_dim))
    fitted = probe.fit_probe(data.where(F.col("split") == train_split), c, penalty)
    preds = probe.predict(fitted, data)
    coefs = probe.probe_coefficients(fitted[1], tiles.sparkSession)
    return {
        "match_report": matched,
        "slide_features": data,
        "predictions": preds,
        "metrics": probe.probe_metrics(preds),
        "coefficients": coefs,
        "top_latents": probe.top_probe_latents(coefs),
    }


def percentile_workflow(tiles: DataFrame, model: LatentModel, q: float, max_tiles: int, seed: int, tiles_per_slide: int = 0) -> Tables:
    """Clamp value per latent from a uniform tile sample (P7), or from all tiles if ``max_tiles`` is negative."""
    latent_dim, _ = model.shape()
    sampled = sampling.cap_tiles(tiles, tiles_per_slide, seed, "percentile")
    if max_tiles >= 0:
        sampled = settle(sampling.uniform_sample(sampled, max_tiles, seed, ["slide_key", "tile_index"]))
    hits = settle(encode.encode_hits(sampled, model).select("latent_idx", "z"))
    return {"clamp": stats.percentile_clamp(hits, sampled.select("slide_key", "tile_index"), q, latent_dim)}


def registry_tables(raw_slides: DataFrame, raw_features: DataFrame, tiles: DataFrame, dims: dict[str, int] | int) -> Tables:
    """Registry, its reports, layout issues and health of the tile table."""
    slides, features = registry.load_slides(raw_slides), registry.load_features(raw_features)
    mapping, no_slide, no_feature, ambiguous = registry.registry(slides, features)
    rows, by_encoder = registry.health(tiles, dims)
    return {
        "slides": slides,
        "features": features,
        "mapping": mapping,
        "missing_slides": no_slide,
        "missing_features": no_feature,
        "ambiguous_slides": ambiguous,
        "issues": registry.validate(slides, tiles, dims, rows=rows),
        "health": rows,
        "health_by_encoder": by_encoder,
    }
