"""Whole workflows P1-P9 over the dense fixture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog import registry  # noqa: F401  (registers its views)
from latentlake.catalog.base import query
from latentlake.catalog.fixtures import VIEWS
from latentlake.catalog.mining import RUN
from latentlake.catalog.mining import _diverse_sql
from latentlake.catalog.probe import dense_probe_inputs
from latentlake.catalog.stats import _damaged
from latentlake.operators import encode
from latentlake.plans import workflows

CFG = workflows.MineConfig(
    strategies=("top_activation", "sdf_parent_balanced"), n_latents=8, topn=10, buffer_factor=4.0, per_slide=2,
    min_px=300, tiles_per_slide=0,
)


def _inputs(spark, sf):
    parents = encode.parent_assignment(encode.coefficients(fx.level2(spark, sf)))
    return fx.tiles(spark, sf), fx.dense_slides(spark, sf), fx.model(spark, sf), parents


def _selected_view(where: str) -> str:
    """Both strategies over the tiles of ``where``; the balanced rule as one sort on non-negative scores."""
    return f"""
WITH st AS (SELECT latent_idx, max(greatest(a, 0)) AS score FROM pre WHERE {where} GROUP BY 1),
ch AS (SELECT latent_idx, score, parent, row_number() OVER (PARTITION BY parent ORDER BY score DESC, latent_idx) - 1 AS child FROM st JOIN parents USING (latent_idx)),
par AS (SELECT parent, row_number() OVER (ORDER BY score DESC, parent) AS prank, score AS best FROM ch WHERE child = 0),
cand AS (SELECT latent_idx, child, prank, row_number() OVER (ORDER BY prank > 2, child > 0, CASE WHEN child = 0 THEN prank END,
  score - child * (SELECT median(best) / 8.0 FROM par WHERE prank <= 2) DESC, score DESC, child, parent) AS turn FROM ch JOIN par USING (parent) WHERE child < 6)
SELECT 'top_activation' AS latent_strategy, latent_idx, row_number() OVER (ORDER BY score DESC, latent_idx DESC) AS sel_pos FROM st QUALIFY sel_pos <= 8
UNION ALL SELECT 'sdf_parent_balanced', latent_idx, row_number() OVER (ORDER BY prank, child) FROM cand WHERE turn <= 8"""


VIEWS["sel_all"] = ("pre parents", _selected_view("true"))
VIEWS["sel_train"] = ("pre parents", _selected_view("split = 'train'"))
VIEWS["sel_test"] = ("pre parents", _selected_view("split = 'test'"))
VIEWS["top_all"] = (
    "dense sel_all",
    _diverse_sql("dense", "latent_idx IN (SELECT latent_idx FROM sel_all)", 40, 2, 300, 10),
)
VIEWS["top_export"] = (
    "dense sel_train",
    _diverse_sql("dense", "split = 'test' AND latent_idx IN (SELECT latent_idx FROM sel_train)", 40, 2, 300, 10),
)
VIEWS["top_test"] = (
    "dense sel_test",
    _diverse_sql("dense", "split = 'test' AND latent_idx IN (SELECT latent_idx FROM sel_test)", 40, 2, 300, 10),
)
_TOP = ["latent_idx", "source_rank", "slide_key", "tile_index", "coord_x", "coord_y", "z"]


@query("p1_mine_top_tiles", needs="top_all", d="z", sql="SELECT * FROM top_all")
def p1(spark, sf):
    tiles, slides, model, parents = _inputs(spark, sf)
    return workflows.mine(tiles, slides, model, CFG, parents)["top_tiles"].select(*_TOP)


@query(
    "p1_mine_selected",
    needs="sel_all parents",
    sql="SELECT latent_strategy, sel_pos, s.latent_idx, 'parent_' || parent AS latent_group FROM sel_all s JOIN parents USING (latent_idx)",
)
def p1_selected(spark, sf):
    tiles, slides, model, parents = _inputs(spark, sf)
    return workflows.mine(tiles, slides, model, CFG, parents)["selected"].select("latent_strategy", "sel_pos", "latent_idx", "latent_group")


_GOOD = "CAST(substr(slide_key, 2) AS BIGINT) % 8 NOT IN (1, 3, 5)"
VIEWS["sel_good"] = ("pre parents", _selected_view(_GOOD))
VIEWS["top_good"] = (
    "dense sel_good",
    _diverse_sql("dense", f"{_GOOD} AND latent_idx IN (SELECT latent_idx FROM sel_good)", 40, 2, 300, 10),
)


@query("p1_mine_damaged", needs="top_good", d="z", sql="SELECT * FROM top_good")
def p1_damaged(spark, sf):
    """Slides with null, short or non-finite vectors are left out; the rest is mined."""
    _, slides, model, parents = _inputs(spark, sf)
    return workflows.mine(_damaged(spark, sf, copies=False), slides, model, CFG, parents)["top_tiles"].select(*_TOP)


@query(
    "p1_reject_counts",
    needs="tiles",
    sql="""SELECT CASE CAST(substr(slide_key, 2) AS BIGINT) % 8 WHEN 1 THEN 'null_features' WHEN 3 THEN 'bad_feature_shape' ELSE 'non_finite_value' END AS reason,
  count(DISTINCT slide_key) AS slides FROM tiles WHERE CAST(substr(slide_key, 2) AS BIGINT) % 8 IN (1, 3, 5) GROUP BY 1""",
)
def p1_rejects(spark, sf):
    _, slides, model, _ = _inputs(spark, sf)
    rejected = workflows.view_tiles(_damaged(spark, sf, copies=False), slides, CFG, model.shape()[1])[1]
    return rejected.groupBy("reason").agg(F.count("*").alias("slides"))


VIEWS["flow_support"] = (
    "top_export sel_train parents dense_slides",
    """
SELECT s.latent_strategy, t.latent_idx, 'parent_' || parent AS latent_group, t.source_rank, t.slide_key, d.case_id, d.cohort, t.tile_index,
  t.z AS activation, feature_path, count(*) OVER w AS slide_support_count, max(t.z) OVER w AS slide_max_activation, avg(t.z) OVER w AS slide_mean_activation
FROM top_export t JOIN sel_train s ON s.latent_idx = t.latent_idx JOIN parents p ON p.latent_idx = t.latent_idx JOIN dense_slides d ON d.slide_key = t.slide_key
WINDOW w AS (PARTITION BY s.latent_strategy, t.latent_idx, t.slide_key)""",
)
VIEWS["flow_ranked"] = ("flow_support", VIEWS["ranked"][1].replace("FROM support)", "FROM flow_support)"))
_REP = [
    "latent_strategy", "latent_idx", "latent_group", "representative_method", "method_rank", "source_rank", "case_id",
    "slide_key", "tile_index", "activation", "method_score",
]


def _bundle(spark, sf):
    tiles, slides, model, parents = _inputs(spark, sf)
    return workflows.representatives_bundle(tiles, slides, model, CFG, RUN, parents, root="/lake")


@query(
    "p2_representatives",
    needs="flow_ranked",
    d="activation method_score",
    sql=f"SELECT {', '.join(_REP)} FROM flow_ranked WHERE method_rank = 1",
)
def p2(spark, sf):
    return _bundle(spark, sf)["representative_latents"].select(*_REP)


@query("p2_support_tiles", needs="flow_ranked", d="activation method_score", sql=f"SELECT {', '.join(_REP)} FROM flow_ranked")
def p2_support(spark, sf):
    return _bundle(spark, sf)["representative_support_tiles"].select(*_REP)


@query(
    "p3_cohort_enrichment",
    needs="dense dense_slides sel_train",
    d="prevalence_in_cohort prevalence_global enrichment_ratio",
    sql="""WITH f AS (SELECT DISTINCT latent_idx, slide_key, cohort FROM dense),
c AS (SELECT cohort, count(*) AS slides_in_cohort FROM dense_slides WHERE cohort <> '' GROUP BY 1),
g AS (SELECT s.latent_strategy, s.latent_idx, c.*, (SELECT count(*) FROM f WHERE f.latent_idx = s.latent_idx AND f.cohort = c.cohort) AS slides_with_activation,
  (SELECT count(*) FROM f WHERE f.latent_idx = s.latent_idx) / (SELECT count(*) FROM dense_slides) AS prevalence_global FROM sel_train s CROSS JOIN c)
SELECT *, slides_with_activation / slides_in_cohort AS prevalence_in_cohort,
  CASE WHEN prevalence_global > 0 THEN slides_with_activation / slides_in_cohort / prevalence_global ELSE 0 END AS enrichment_ratio FROM g""",
)
def p3(spark, sf):
    tiles, slides, model, parents = _inputs(spark, sf)
    selected = workflows.mine(tiles, slides.where("split = 'train'"), model, CFG, parents)["selected"]
    tables = workflows.analytics_tables(tiles, slides, model, selected, fx.LATENTS)
    return tables["cohort_enrichment"].drop("latent_group")


@query(
    "p4_bundle_targets",
    needs="top_test",
    d="target_soft target_strong clamp_strong",
    sql="""SELECT latent_idx, count(*) AS source_top_tiles_count_used, quantile_cont(z, 0.5) AS target_soft, quantile_cont(z, 0.9) AS target_strong,
  quantile_cont(z, 0.25) AS clamp_strong FROM top_test GROUP BY 1""",
)
def p4(spark, sf):
    tiles, slides, model, parents = _inputs(spark, sf)
    out = workflows.mine_bundle(tiles, slides, model, CFG, RUN, parents)["target_presets"]
    return out.select("latent_idx", "source_top_tiles_count_used", "target_soft", "target_strong", "clamp_strong")


@query(
    "p5_materialize_summary",
    needs="flow_ranked",
    sql="""WITH r AS (SELECT slide_key, tile_index, cohort FROM flow_ranked
  UNION ALL SELECT slide_key, tile_index, cohort FROM flow_ranked WHERE method_rank = 1)
SELECT count(*) AS rows_total, count_if(cohort <> 'C4') AS rows_with_feature_vector, count_if(cohort = 'C4') AS rows_missing_feature,
  count_if(cohort IN ('C0', 'C4')) AS rows_missing_slide, 0 AS rows_feature_error,
  count(DISTINCT CASE WHEN cohort <> 'C4' THEN slide_key || '/' || tile_index END) AS unique_feature_vectors FROM r""",
)
def p5(spark, sf):
    """One cohort has no feature files in the lake, two have no slide files."""
    tiles, slides, _, _ = _inputs(spark, sf)
    bundle = _bundle(spark, sf)
    known = slides.withColumn("wsi_path", F.expr("concat('/lake/wsi_slides/', slide_key, '.svs')"))
    mapping = known.select(
        F.col("slide_key").alias("slide_id"), F.lit("TCGA").alias("dataset"), "cohort", F.lit("").alias("slide_filename"),
        "wsi_path", F.lit("").alias("uni_path"), F.lit("").alias("seal_path"),
    )
    features = known.select(F.col("slide_key").alias("slide_id"), F.lit("seal").alias("encoder"), "feature_path", F.lit(0).alias("ord"))
    listing = known.where("cohort <> 'C4'").select(F.col("feature_path").alias("path")).unionByName(
        known.where("cohort not in ('C0', 'C4')").select(F.col("wsi_path").alias("path"))
    )
    group = ["latent_strategy", "latent_idx", "representative_method"]
    out = workflows.materialize_bundle(
        bundle["representative_latents"], bundle["representative_support_tiles"], group, tiles, mapping, features, listing, "/lake"
    )
    return out["materialize_summary"]


@query("p6_probe_metrics", d="auc acc balanced_acc f1 precision recall specificity")
def p6(spark, sf):
    slides, labels = dense_probe_inputs(spark, sf)
    return workflows.probe_workflow(fx.tiles(spark, sf), slides, labels, fx.model(spark, sf))["metrics"]


@query(
    "p7_percentile_clamp",
    needs="pre tiles",
    d="clamp_value",
    sql="""WITH s AS (SELECT slide_key, tile_index FROM (SELECT *, row_number() OVER (PARTITION BY slide_key
    ORDER BY md5(concat_ws('|', '9', 'percentile', slide_key, tile_index)), tile_index) AS rn FROM tiles) WHERE rn <= 15
  ORDER BY md5(concat_ws('|', '9', 'sample', slide_key, tile_index)), slide_key, tile_index LIMIT 200)
SELECT latent_idx, quantile_cont(greatest(a, 0), 0.9) AS clamp_value FROM pre JOIN s USING (slide_key, tile_index) GROUP BY 1""",
)
def p7(spark, sf):
    return workflows.percentile_workflow(fx.tiles(spark, sf), fx.model(spark, sf), 90.0, 200, 9, tiles_per_slide=15)["clamp"]


@query(
    "p7_percentile_clamp_all",
    needs="pre",
    d="clamp_value",
    sql="SELECT latent_idx, quantile_cont(greatest(a, 0), 0.9) AS clamp_value FROM pre GROUP BY 1",
)
def p7_all(spark, sf):
    return workflows.percentile_workflow(fx.tiles(spark, sf), fx.model(spark, sf), 90.0, -1, 9)["clamp"]


@query(
    "p8_viewer_summary",
    needs="top_test parents",
    d="best_activation",
    sql="""SELECT t.latent_idx, 'parent_' || any_value(parent) AS latent_group, count(*) AS top_tile_count, count(DISTINCT slide_key) AS unique_slide_count,
  max(z) AS best_activation, arg_min(slide_key, source_rank) AS best_slide_key, arg_min(tile_index, source_rank) AS best_tile_index
FROM top_test t JOIN parents p ON p.latent_idx = t.latent_idx GROUP BY 1""",
)
def p8(spark, sf):
    tiles, slides, model, parents = _inputs(spark, sf)
    test = slides.where("split = 'test'")
    mined = workflows.mine(tiles, test, model, CFG, parents)
    tables = workflows.viewer_tables(mined["top_tiles"], test, mined["stats"], mined["selected"], RUN, parents)
    return tables["viewer_latent_summary"].select(
        "latent_idx", "latent_group", "top_tile_count", "unique_slide_count", "best_activation", "best_slide_key", "best_tile_index"
    )


@query(
    "p9_registry_tables",
    needs="reg slide_list feature_list tiles",
    sql="""SELECT 'slides' AS name, count(*) AS rows FROM slide_list UNION ALL SELECT 'features', count(*) FROM feature_list
UNION ALL SELECT 'mapping', count_if(listed <= 1) FROM reg UNION ALL SELECT 'missing_slides', count_if(listed = 0 AND has_feature) FROM reg
UNION ALL SELECT 'missing_features', count_if(listed = 1 AND NOT has_feature) FROM reg UNION ALL SELECT 'ambiguous_slides', count_if(listed > 1) FROM reg
UNION ALL SELECT 'issues', 2 + (SELECT count(DISTINCT cohort) FROM tiles) UNION ALL SELECT 'health', count(DISTINCT slide_key) FROM tiles
UNION ALL SELECT 'health_by_encoder', count(DISTINCT encoder) FROM tiles""",
)
def p9(spark, sf):
    tables = workflows.registry_tables(fx.slide_list(spark, sf), fx.feature_list(spark, sf), fx.tiles(spark, sf), fx.D_IN)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


