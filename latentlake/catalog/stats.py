"""Latent statistics and monitors: G1, G2, G17, G23-G27, G29-G31 and the stream X1."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog.base import query
from latentlake.operators import encode, filters, order_stats, pooling, registry, sampling, selection, stats
from latentlake.runtime import scratch_path, settle
from latentlake.streaming import incremental


def _count(df):
    return df.agg(F.count("*").alias("n")).scalar()


_G1 = "latent_idx, n_tiles, z_max, z_sum, z_sum_sq, nnz"
_G1_TOPK = """WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_key, tile_index ORDER BY abs(a) DESC, latent_idx) AS rn
  FROM pre) WHERE rn <= 3)
SELECT u.latent_idx, n AS n_tiles, max(a) AS z_max, coalesce(sum(a), 0) AS z_sum, coalesce(sum(a * a), 0) AS z_sum_sq, count(a) AS nnz
FROM (SELECT DISTINCT latent_idx FROM pre) u CROSS JOIN dense_n LEFT JOIN h ON h.latent_idx = u.latent_idx GROUP BY u.latent_idx, n"""


@query("g1_latent_stats", needs="dense_stats", d="z_max z_sum z_sum_sq", sql=f"SELECT {_G1} FROM dense_stats")
def g1(spark, sf):
    return encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf))


@query("g1_latent_stats_blocked", needs="dense_stats", d="z_max z_sum z_sum_sq", sql=f"SELECT {_G1} FROM dense_stats")
def g1_blocked(spark, sf):
    return encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf, block_bytes=16 * fx.D_IN * 8))


@query(
    "g1_latent_stats_topk",
    needs="pre dense_n",
    d="z_max z_sum z_sum_sq",
    sql=_G1_TOPK,
)
def g1_topk(spark, sf):
    return encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf, kind="topk", k=3, mode="magnitude"))


@query("g1_latent_stats_topk_blocked", d="z_max z_sum z_sum_sq", needs="pre dense_n", sql=_G1_TOPK)
def g1_topk_blocked(spark, sf):
    """The same when the encoder comes in blocks of ten latents: the same rows, never-hit latents included."""
    return encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf, kind="topk", k=3, mode="magnitude", block_bytes=64 * 8 * 10))


@query("g1_latent_stats_table", needs="sparse_stats", d="z_max z_sum z_sum_sq", sql=f"SELECT {_G1} FROM sparse_stats")
def g1_table(spark, sf):
    return stats.latent_stats(fx.acts(spark, sf), _count(fx.sparse_keys(spark, sf)), fx.SPARSE_LATENTS)


@query(
    "g2_finalize_stats",
    needs="dense_stats",
    d="mean variance sparsity",
    sql="SELECT latent_idx, mean, variance, sparsity FROM dense_stats",
)
def g2(spark, sf):
    out = stats.finalize_stats(encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf)))
    return out.select("latent_idx", "mean", "variance", "sparsity")


@query(
    "g17_percentile_clamp",
    needs="sparse_tiles acts",
    d="clamp_value",
    sql="""WITH s AS (SELECT slide_key, tile_index FROM sparse_tiles
  ORDER BY md5(concat_ws('|', '1337', 'sample', slide_key, tile_index)), slide_key, tile_index LIMIT 5000)
SELECT r.range AS latent_idx, quantile_cont(coalesce(z, 0), 0.995) AS clamp_value
FROM s CROSS JOIN range(64) r LEFT JOIN acts a ON a.slide_key = s.slide_key AND a.tile_index = s.tile_index AND a.latent_idx = r.range
GROUP BY 1""",
)
def g17(spark, sf):
    sampled = settle(sampling.uniform_sample(fx.sparse_keys(spark, sf), 5000, 1337, ["slide_key", "tile_index"]))
    hits = fx.acts(spark, sf).join(sampled, ["slide_key", "tile_index"], "left_semi")
    return stats.percentile_clamp(hits, sampled, 99.5, fx.SPARSE_LATENTS)


@query(
    "g17_percentile_clamp_encoded",
    needs="pre",
    d="clamp_value",
    sql="SELECT latent_idx, quantile_cont(greatest(a, 0), 0.95) AS clamp_value FROM pre GROUP BY 1",
)
def g17_encoded(spark, sf):
    tiles = fx.tiles(spark, sf)
    sampled = settle(sampling.uniform_sample(tiles, 50_000, 1337, ["slide_key", "tile_index"]))
    hits = settle(encode.encode_hits(sampled, fx.model(spark, sf)).select("latent_idx", "z"))
    return stats.percentile_clamp(hits, sampled.select("slide_key", "tile_index"), 95.0, fx.LATENTS)


@query(
    "g17_percentile_all_tiles",
    needs="sparse_tiles acts",
    d="clamp_value",
    sql="""SELECT r.range AS latent_idx, quantile_cont(coalesce(z, 0), 0.97) AS clamp_value
FROM sparse_tiles s CROSS JOIN range(64) r LEFT JOIN acts a ON a.slide_key = s.slide_key AND a.tile_index = s.tile_index AND a.latent_idx = r.range
GROUP BY 1""",
)
def g17_all(spark, sf):
    """Every tile instead of a sample: ranks are selected by counts, whatever a latent's number of values."""
    return stats.percentile_clamp(fx.acts(spark, sf), fx.sparse_keys(spark, sf), 97.0, fx.SPARSE_LATENTS)


@query(
    "g17_order_statistics",
    d="value",
    digits=2,
    sql="""SELECT l_suppkey AS supplier, rank, value FROM (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) AS value,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS rank FROM lineitem)
WHERE rank IN (0, 7, 100)""",
)
def g17_ranks(spark, sf):
    """Values at given ranks of every group."""
    values = fx._read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_extendedprice").cast("double").alias("z"), F.lit(1).cast("long").alias("freq"))
    ranks = values.select("supplier").distinct().select("supplier", F.explode(F.array(*(F.lit(r).cast("long") for r in (0, 7, 100)))).alias("rank"))
    return order_stats.at_ranks(values, ranks, "supplier")


@query(
    "g23_slide_summary",
    needs="pre",
    d="z_mean z_max z_nzfrac",
    sql="""SELECT slide_key, latent_idx, avg(greatest(a, 0)) AS z_mean, max(greatest(a, 0)) AS z_max,
  avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END) AS z_nzfrac FROM pre GROUP BY 1, 2""",
)
def g23(spark, sf):
    tiles = fx.tiles(spark, sf)
    partials = encode.encode_slide_stats(tiles, fx.model(spark, sf))
    axis = F.sequence(F.lit(0).cast("bigint"), F.lit(fx.LATENTS - 1).cast("bigint"))
    return stats.slide_summary(partials, stats.count_tiles(tiles), axis)


@query(
    "g23_slide_summary_topk",
    needs="pre",
    d="z_mean z_max z_nzfrac",
    sql="""WITH h AS (SELECT *, row_number() OVER (PARTITION BY slide_key, tile_index ORDER BY abs(a) DESC, latent_idx) AS rn FROM pre),
z AS (SELECT slide_key, latent_idx, CASE WHEN rn <= 6 THEN a ELSE 0 END AS z FROM h)
SELECT slide_key, latent_idx, avg(z) AS z_mean, max(z) AS z_max, avg(CASE WHEN z <> 0 THEN 1.0 ELSE 0.0 END) AS z_nzfrac FROM z GROUP BY 1, 2""",
)
def g23_topk(spark, sf):
    tiles = fx.tiles(spark, sf)
    partials = encode.encode_slide_stats(tiles, fx.model(spark, sf, kind="topk", k=6, mode="magnitude"))
    axis = F.sequence(F.lit(0).cast("bigint"), F.lit(fx.LATENTS - 1).cast("bigint"))
    return stats.slide_summary(partials, stats.count_tiles(tiles), axis)


_G24 = """WITH z AS (SELECT slide_key, tile_index, greatest(a, 0) AS z FROM pre),
t AS (SELECT slide_key, tile_index, count_if(z > 0) AS nz, list(z ORDER BY z DESC) AS l FROM z GROUP BY 1, 2)
SELECT (SELECT avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END) FROM z) AS frac_nonzero, avg(nz) AS mean_nonzero_per_sample,
  (SELECT avg(z) FROM z) AS z_mean, (SELECT stddev_pop(z) FROM z) AS z_std, avg(l[1] - l[2]) AS top1_top2_margin FROM t"""
_G24_D = "frac_nonzero mean_nonzero_per_sample z_mean z_std top1_top2_margin"


@query("g24_activation_monitor", needs="pre", d=_G24_D, sql=_G24)
def g24(spark, sf):
    return encode.encode_monitor(fx.tiles(spark, sf), fx.model(spark, sf))


@query("g24_activation_monitor_table", needs="pre", d=_G24_D, sql=_G24)
def g24_table(spark, sf):
    tiles = fx.tiles(spark, sf)
    hits = encode.encode_hits(tiles, fx.model(spark, sf))
    return stats.activation_monitor(hits, _count(tiles), fx.LATENTS)


@query("g24_activation_monitor_blocked", needs="pre", d=_G24_D, sql=_G24)
def g24_blocked(spark, sf):
    """Weights in blocks of 7 latents: the two largest activations of a tile come from any two of them."""
    return encode.encode_monitor(fx.tiles(spark, sf), fx.model(spark, sf, block_bytes=7 * fx.D_IN * 8))


@query(
    "g24_activation_monitor_batch_topk",
    needs="pre",
    d=_G24_D,
    sql="""WITH r AS (SELECT slide_key, tile_index, a, row_number() OVER (PARTITION BY slide_key, tile_index // 8 ORDER BY abs(a) DESC, latent_idx, tile_index) AS rn,
  count(DISTINCT tile_index) OVER (PARTITION BY slide_key, tile_index // 8) AS b FROM pre),
z AS (SELECT slide_key, tile_index, CASE WHEN rn <= 3 * b THEN a ELSE 0 END AS z FROM r),
t AS (SELECT slide_key, tile_index, count_if(z <> 0) AS nz, list(z ORDER BY z DESC) AS l FROM z GROUP BY 1, 2)
SELECT (SELECT avg(CASE WHEN z <> 0 THEN 1.0 ELSE 0.0 END) FROM z) AS frac_nonzero, avg(nz) AS mean_nonzero_per_sample,
  (SELECT avg(z) FROM z) AS z_mean, (SELECT stddev_pop(z) FROM z) AS z_std, avg(l[1] - l[2]) AS top1_top2_margin FROM t""",
)
def g24_batch(spark, sf):
    model = fx.model(spark, sf, kind="batch_topk", k=3, chunk_tiles=8, mode="magnitude", block_bytes=7 * fx.D_IN * 8)
    return encode.encode_monitor(fx.tiles(spark, sf), model)


_G25 = """WITH l AS (SELECT latent_idx, max(greatest(a, 0)) AS top, avg(greatest(a, 0)) AS m FROM pre GROUP BY 1)
SELECT 1.0 - avg(CASE WHEN top > 0.15 THEN 1.0 ELSE 0.0 END) AS dead_frac, avg(m) AS mean_abs_act_per_latent,
  max(m) AS max_abs_act_per_latent FROM l"""
_G25_D = "dead_frac mean_abs_act_per_latent max_abs_act_per_latent"


@query("g25_dead_units", needs="pre", d=_G25_D, sql=_G25)
def g25(spark, sf):
    partials = encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf))
    return stats.dead_units_from_stats(partials, fx.LATENTS, eps=0.15)


@query("g25_dead_units_table", needs="pre", d=_G25_D, sql=_G25)
def g25_table(spark, sf):
    tiles = fx.tiles(spark, sf)
    hits = encode.encode_hits(tiles, fx.model(spark, sf))
    return stats.dead_units(hits, _count(tiles), fx.LATENTS, eps=0.15)


@query(
    "g26_reconstruction_error",
    needs="pre tile_dims model_dims dense",
    d="mse l1",
    sql="""WITH h AS (SELECT slide_key, tile_index, m.dim, sum(z * w) AS x_hat FROM dense JOIN model_dims m USING (latent_idx) GROUP BY ALL)
SELECT avg(pow(x - coalesce(x_hat, 0), 2)) AS mse, (SELECT avg(greatest(a, 0)) FROM pre) AS l1
FROM tile_dims t LEFT JOIN h ON h.slide_key = t.slide_key AND h.tile_index = t.tile_index AND h.dim = t.dim""",
)
def g26(spark, sf):
    recon = encode.reconstruct(fx.tiles(spark, sf), fx.model(spark, sf))
    return stats.reconstruction_error(recon, fx.LATENTS)


@query(
    "g26_reconstruction_error_blocked",
    needs="pre tile_dims model_dims",
    d="mse l1",
    sql="""WITH r AS (SELECT slide_key, tile_index, latent_idx, a AS z, row_number() OVER (PARTITION BY slide_key, tile_index // 8 ORDER BY a DESC, latent_idx, tile_index) AS rn,
  count(DISTINCT tile_index) OVER (PARTITION BY slide_key, tile_index // 8) AS b FROM pre),
k AS (SELECT * FROM r WHERE rn <= 3 * b),
h AS (SELECT slide_key, tile_index, m.dim, sum(z * w) AS x_hat FROM k JOIN model_dims m USING (latent_idx) GROUP BY ALL)
SELECT avg(pow(x - coalesce(x_hat, 0), 2)) AS mse, (SELECT sum(abs(z)) FROM k) / (SELECT count(*) FROM pre) AS l1
FROM tile_dims t LEFT JOIN h ON h.slide_key = t.slide_key AND h.tile_index = t.tile_index AND h.dim = t.dim""",
)
def g26_blocked(spark, sf):
    """Batch TopK over blocks of 7 latents, decoded with the tied weights."""
    model = fx.model(spark, sf, kind="batch_topk", k=3, chunk_tiles=8, block_bytes=7 * fx.D_IN * 8)
    return stats.reconstruction_error(encode.reconstruct(fx.tiles(spark, sf), model), fx.LATENTS)


_USAGE = """WITH c AS (SELECT latent_idx, parent, exp(raw) / sum(exp(raw)) OVER (PARTITION BY latent_idx) AS v FROM level2_dims),
m AS (SELECT parent, avg(v) AS m FROM c GROUP BY 1), u AS (SELECT parent, m / (SELECT sum(m) FROM m) AS usage FROM m)"""


@query("g27_parent_usage", needs="level2_dims", d="usage", sql=f"{_USAGE} SELECT parent, usage FROM u")
def g27(spark, sf):
    return stats.parent_usage(encode.coefficients(fx.level2(spark, sf), simplex=True))


@query(
    "g27_usage_summary",
    needs="level2_dims",
    d="balance_mse entropy usage_min usage_max",
    sql=f"""{_USAGE} SELECT avg(pow(usage - 1.0 / 8, 2)) AS balance_mse, -sum(usage * ln(usage)) / ln(8) AS entropy,
  min(usage) AS usage_min, max(usage) AS usage_max FROM u""",
)
def g27_summary(spark, sf):
    return stats.usage_summary(stats.parent_usage(encode.coefficients(fx.level2(spark, sf), simplex=True)))


@query(
    "g29_hierarchy",
    needs="parents dense_stats",
    sql="""WITH s AS (SELECT latent_idx, row_number() OVER (ORDER BY z_max DESC, latent_idx DESC) AS pos FROM dense_stats),
c AS (SELECT parent, string_agg(CAST(latent_idx AS VARCHAR), '|' ORDER BY pos) AS children FROM s JOIN parents USING (latent_idx)
  WHERE pos <= 12 GROUP BY 1)
SELECT parent, count(*) AS child_count, coalesce(any_value(children), '') AS selected_children
FROM parents LEFT JOIN c USING (parent) GROUP BY 1""",
)
def g29(spark, sf):
    st = stats.finalize_stats(encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf)))
    chosen = selection.select_latents(st, "top_activation", 12)
    parents = encode.parent_assignment(encode.coefficients(fx.level2(spark, sf)))
    out = selection.hierarchy(parents, chosen)
    return out.select("parent", "child_count", F.concat_ws("|", "selected_children").alias("selected_children"))


def _damaged(spark, sf, copies=True):
    """Tiles with some null, short, non-finite and, with ``copies``, duplicated rows."""
    tiles = fx.tiles(spark, sf).withColumn("sn", F.expr("cast(substr(slide_key, 2) as bigint)"))
    features = F.expr(
        "case when sn % 8 = 1 and tile_index = 4 then null when sn % 8 = 3 and tile_index = 5 then slice(features, 1, 10) "
        "when sn % 8 = 5 and tile_index = 6 then transform(features, x -> float('NaN')) else features end"
    )
    tiles = tiles.withColumn("features", features)
    return tiles if not copies else tiles.withColumn("tile_index", F.expr("if(sn % 8 = 6 and tile_index = 9, 8, tile_index)"))


_HEALTH = """WITH s AS (SELECT DISTINCT encoder, cohort, slide_key, CAST(substr(slide_key, 2) AS BIGINT) % 8 AS r FROM tiles),
h AS (SELECT encoder, cohort, slide_key, CASE r WHEN 1 THEN 'null_features' WHEN 3 THEN 'bad_feature_shape'
  WHEN 5 THEN 'non_finite_value' WHEN 6 THEN 'duplicate_tile_index' ELSE '' END AS error FROM s)"""


@query(
    "g30_health_rows",
    needs="tiles",
    sql="""WITH t AS (SELECT * REPLACE (CASE WHEN r = 6 AND tile_index = 9 THEN 8 ELSE tile_index END AS tile_index), tile_index AS was
  FROM (SELECT *, CAST(substr(slide_key, 2) AS BIGINT) % 8 AS r FROM tiles)),
s AS (SELECT encoder, cohort, slide_key, bool_or(r = 1 AND was = 4 OR features IS NULL) AS no_vec, bool_or(r = 3 AND was = 5 OR len(features) <> 64) AS bad_dim,
  bool_or(r = 5 AND was = 6 OR list_count(features) < len(features) OR NOT isfinite(list_min(features)) OR NOT isfinite(list_max(features))) AS bad_val,
  count(*) > count(DISTINCT tile_index) AS twice, count(*) AS num_tiles,
  max(CASE WHEN r = 1 AND was = 4 THEN NULL WHEN r = 3 AND was = 5 THEN least(len(features), 10) ELSE len(features) END) AS feature_dim FROM t GROUP BY 1, 2, 3),
h AS (SELECT *, CASE WHEN no_vec THEN 'null_features' WHEN bad_dim THEN 'bad_feature_shape' WHEN bad_val THEN 'non_finite_value'
  WHEN twice THEN 'duplicate_tile_index' ELSE '' END AS error FROM s)
SELECT encoder, cohort, slide_key, CASE WHEN error = '' THEN 'ok' ELSE 'error' END AS status, error, num_tiles, feature_dim FROM h""",
)
def g30(spark, sf):
    return registry.health(_damaged(spark, sf), {"uni2": 64, "seal": 64})[0]


@query(
    "g30_health_by_encoder",
    needs="tiles",
    sql=f"{_HEALTH} SELECT encoder, count_if(error = '') AS ok, count_if(error <> '') AS error FROM h GROUP BY 1",
)
def g30_encoder(spark, sf):
    return registry.health(_damaged(spark, sf), 64)[1]


@query(
    "g31_reject_summary",
    needs="grid_tiles doc_names",
    sql="""SELECT reason, count(*) AS rejected FROM (
  SELECT CASE CAST(substr(slide_key, 2) AS BIGINT) % 9 WHEN 4 THEN 'inconsistent_spacing' ELSE 'duplicate_cell' END AS reason
    FROM (SELECT DISTINCT slide_key FROM grid_tiles) WHERE CAST(substr(slide_key, 2) AS BIGINT) % 9 IN (4, 7)
  UNION ALL SELECT CASE WHEN quality < 0 THEN 'no_label' ELSE 'bad_suffix' END FROM doc_names WHERE quality < 0 OR NOT (path LIKE '%.h5'))
GROUP BY 1""",
)
def g31(spark, sf):
    grid = pooling.geometry_rejects(fx.grid_tiles(spark, sf)).select("reason")
    rules = [("no_label", F.col("quality") < 0), ("bad_suffix", ~F.col("path").endswith(".h5"))]
    names = filters.rejects(fx.doc_names(spark, sf), rules)[1].select("reason")
    return stats.reject_summary(grid.unionByName(names))


_X1 = """SELECT latent_idx, max(z) AS z_max, sum(z) AS z_sum, sum(z * z) AS z_sum_sq, count_if(z > 0) AS nnz, count(*) AS n_rows
FROM (SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS latent_idx,
  ln(1 + abs(value)) AS z FROM events) GROUP BY 1"""


def _streamed(spark, sf, fold_every):
    """The event table fed as a stream of eight files, merged batch by batch."""
    source, target = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-stats")
    kinds = "array('click', 'error', 'purchase', 'signup', 'view')"
    acts = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        f"cast(array_position({kinds}, event_type) - 1 as bigint) as latent_idx", "ln(1 + abs(value)) as z"
    )
    acts.repartition(8).write.parquet(source)
    stream = spark.readStream.schema(acts.schema).option("maxFilesPerTrigger", 2).parquet(source)
    job = incremental.incremental_stats(stream, target, scratch_path(spark, "stream-checkpoint"), fold_every=fold_every)
    job.awaitTermination()
    return incremental.read_incremental(spark, target)


@query("x1_incremental_stats", d="z_max z_sum z_sum_sq", digits=4, sql=_X1)
def x1(spark, sf):
    return _streamed(spark, sf, 100)


@query("x1_incremental_stats_folded", d="z_max z_sum z_sum_sq", digits=4, sql=_X1)
def x1_folded(spark, sf):
    """Three of the four batches lie in a folded base."""
    return _streamed(spark, sf, 3)
