"""Prototypes, targets and their statistics: G13-G16, H15, C9."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog.base import query
from latentlake.catalog.fixtures import VIEWS
from latentlake.operators import encode, mining, prototypes

VIEWS["proto_top"] = (
    "dense",
    """SELECT * FROM (SELECT latent_idx, slide_key, tile_index, z AS score,
  row_number() OVER (PARTITION BY latent_idx ORDER BY z DESC, slide_key, tile_index) AS source_rank FROM dense) WHERE source_rank <= 15""",
)
VIEWS["proto_codes"] = (
    "proto_top pre",
    """SELECT t.latent_idx, t.slide_key, t.tile_index, t.score, p.latent_idx AS dim, greatest(p.a, 0) AS z
FROM proto_top t JOIN pre p ON p.slide_key = t.slide_key AND p.tile_index = t.tile_index""",
)
VIEWS["proto_dims"] = (
    "proto_codes",
    "SELECT latent_idx, dim, avg(z) AS proto_mean, median(z) AS proto_median FROM proto_codes GROUP BY 1, 2",
)


def _top(spark, sf):
    return encode.encode_top(fx.tiles(spark, sf), fx.model(spark, sf), 15)


@query(
    "g13_prototypes",
    needs="proto_dims",
    d="proto_mean proto_median",
    sql="SELECT latent_idx, dim, proto_mean, proto_median FROM proto_dims",
)
def g13(spark, sf):
    out = prototypes.prototypes(_top(spark, sf), fx.tiles(spark, sf), fx.model(spark, sf))
    pairs = F.arrays_zip(F.col("prototype_mean").alias("a"), F.col("prototype_median").alias("b"))
    long = out.select("latent_idx", F.posexplode(pairs).alias("dim", "p"))
    return long.select("latent_idx", "dim", F.col("p.a").alias("proto_mean"), F.col("p.b").alias("proto_median"))


_G14 = "raw_score_mean self_min self_p50 self_p75 self_p90 self_max self_mean self_std prototype_mean_l2 prototype_median_l2"


@query(
    "g14_prototype_stats",
    needs="proto_codes proto_dims",
    d=_G14,
    sql="""WITH s AS (SELECT latent_idx, count(*) AS top_tiles_used, count(DISTINCT slide_key) AS unique_slide_count, avg(score) AS raw_score_mean,
  min(z) AS self_min, quantile_cont(z, 0.5) AS self_p50, quantile_cont(z, 0.75) AS self_p75, quantile_cont(z, 0.9) AS self_p90,
  max(z) AS self_max, avg(z) AS self_mean, stddev_pop(z) AS self_std FROM proto_codes WHERE dim = latent_idx GROUP BY 1),
n AS (SELECT latent_idx, sqrt(sum(proto_mean * proto_mean)) AS prototype_mean_l2, sqrt(sum(proto_median * proto_median)) AS prototype_median_l2
  FROM proto_dims GROUP BY 1)
SELECT * FROM s JOIN n USING (latent_idx)""",
)
def g14(spark, sf):
    return prototypes.prototype_stats(_top(spark, sf), fx.tiles(spark, sf), fx.model(spark, sf))


@query(
    "h15_top_abs_dims",
    needs="proto_dims",
    d="value",
    sql="""SELECT latent_idx, dim_rank, dim, proto_mean AS value FROM (SELECT *, row_number() OVER (PARTITION BY latent_idx
  ORDER BY abs(proto_mean) DESC, dim) AS dim_rank FROM proto_dims) WHERE dim_rank <= 6""",
)
def h15(spark, sf):
    tiles, model, top = fx.tiles(spark, sf), fx.model(spark, sf), _top(spark, sf)
    codes = prototypes.top_tile_codes(top, tiles, model)
    dims = prototypes.prototype_dims(codes, top.select("latent_idx", "slide_key", "tile_index"))
    return prototypes.top_abs_dims(dims, "proto_mean", 6)


@query(
    "c9_prototype_skips",
    needs="selected dense",
    sql="""SELECT latent_idx, 'missing_or_empty_top_tiles' AS reason FROM selected
WHERE latent_idx NOT IN (SELECT latent_idx FROM dense) AND latent_strategy = 'top_activation'""",
)
def c9_skips(spark, sf):
    chosen = fx.selected(spark, sf).where("latent_strategy = 'top_activation'")
    return prototypes.prototype_skips(chosen, _top(spark, sf), fx.tiles(spark, sf), fx.D_IN)


VIEWS["target_stats"] = (
    "acts",
    """
SELECT latent_idx, count(*) AS count, min(z) AS min, quantile_cont(z, 0.1) AS p10, quantile_cont(z, 0.25) AS p25, quantile_cont(z, 0.5) AS p50,
  quantile_cont(z, 0.75) AS p75, quantile_cont(z, 0.9) AS p90, quantile_cont(z, 0.95) AS p95, quantile_cont(z, 0.99) AS p99, max(z) AS max,
  avg(z) AS mean, stddev_pop(z) AS std
FROM (SELECT *, row_number() OVER (PARTITION BY latent_idx ORDER BY z DESC, slide_key, tile_index) AS r FROM acts) WHERE r <= 40 GROUP BY 1""",
)


def _targets(spark, sf):
    return prototypes.targets(mining.top_tiles(fx.acts(spark, sf), None, 50), top_n=40)


@query("g15_target_stats", needs="target_stats", d="min p10 p25 p50 p75 p90 p95 p99 max mean std", sql="SELECT * FROM target_stats")
def g15(spark, sf):
    return _targets(spark, sf)


@query(
    "g16_target_presets",
    needs="target_stats",
    d="target_soft target_medium target_strong target_very_strong clamp_soft clamp_medium clamp_strong",
    sql="""SELECT latent_idx, count AS source_top_tiles_count_used, p50 AS target_soft, p75 AS target_medium, p90 AS target_strong,
  p95 AS target_very_strong, p75 AS clamp_soft, p50 AS clamp_medium, p25 AS clamp_strong FROM target_stats""",
)
def g16(spark, sf):
    return prototypes.target_presets(_targets(spark, sf))


@query(
    "g16_flat_maps",
    needs="target_stats",
    d="p50 p75 p90",
    sql="SELECT CAST(latent_idx AS VARCHAR) AS latent, p50, p75, p90 FROM target_stats",
)
def g16_maps(spark, sf):
    maps = prototypes.flat_target_maps(_targets(spark, sf))
    keys = maps.select("*", F.explode(F.map_keys("target_p50")).alias("latent"))
    return keys.select("latent", *[F.element_at(f"target_{p}", F.col("latent")).alias(p) for p in ("p50", "p75", "p90")])


@query(
    "g16_target_skips",
    needs="selected sparse_stats",
    sql="""SELECT latent_idx FROM selected WHERE latent_strategy = 'top_sparsity'
  AND latent_idx NOT IN (SELECT latent_idx FROM selected WHERE latent_strategy = 'top_activation')""",
)
def g16_skips(spark, sf):
    """Targets built for one strategy leave the other strategy's own latents without scores."""
    chosen = fx.selected(spark, sf)
    first = chosen.where("latent_strategy = 'top_activation'")
    built = prototypes.targets(mining.top_tiles(fx.acts(spark, sf), first, 20))
    return prototypes.target_skips(chosen.where("latent_strategy = 'top_sparsity'"), built)


