"""Prevalence, enrichment, histograms: G3-G12, J15."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog.base import query
from latentlake.catalog.fixtures import VIEWS
from latentlake.operators import analytics, encode, stats
from latentlake.runtime import settle

VIEWS["slide_latent"] = (
    "acts slides selected sparse_counts",
    """
SELECT s.latent_strategy, s.latent_idx, s.latent_group, d.case_id, d.slide_key, d.cohort,
  coalesce(p.z_max, 0) AS slide_max_activation, coalesce(p.m, 0) AS slide_mean_positive_activation,
  coalesce(p.n, 0) AS positive_tile_count, c.total_tiles AS total_tiles_seen, CASE WHEN p.z_max > 0 THEN 1 ELSE 0 END AS fires
FROM slides d JOIN sparse_counts c USING (slide_key) CROSS JOIN selected s
LEFT JOIN (SELECT slide_key, latent_idx, max(z) AS z_max, avg(z) AS m, count(*) AS n FROM acts GROUP BY 1, 2) p
  ON p.slide_key = d.slide_key AND p.latent_idx = s.latent_idx""",
)
VIEWS["firing"] = (
    "acts slides",
    "SELECT DISTINCT latent_idx, slide_key, case_id, cohort FROM acts JOIN slides USING (slide_key) WHERE z > 1.2",
)


def partials(spark, sf):
    return stats.slide_partials(fx.acts(spark, sf))


def slide_latent(spark, sf):
    acts = fx.stored_acts(spark, sf)
    return _slide_latent(spark, sf, acts, acts, fx.selected(spark, sf, acts))


def _slide_latent(spark, sf, acts, hits, chosen):
    counts = stats.count_tiles(acts.select("slide_key", "tile_index").distinct())
    return settle(analytics.slide_latent_stats(stats.slide_partials(hits), fx.slides(spark, sf), counts, chosen))


def firing(spark, sf, acts=None):
    """Activations less 1.2, so that prevalences lie below one; every row goes in and the operators' own rule (positive) decides."""
    shifted = (fx.acts(spark, sf) if acts is None else acts).withColumn("z", F.col("z") - 1.2)
    strong = stats.slide_partials(shifted)
    return settle(analytics.firing_slides(strong, fx.slides(spark, sf)))


_SL = "slide_max_activation slide_mean_positive_activation"


@query("g3_slide_latent_stats", needs="slide_latent", d=_SL, sql="SELECT * FROM slide_latent")
def g3(spark, sf):
    return slide_latent(spark, sf)


@query(
    "g3_slide_latent_stats_encoded",
    needs="pre",
    d="z_max z_sum z_sum_sq pos_sum",
    sql="""SELECT slide_key, latent_idx, max(a) AS z_max, sum(a) AS z_sum, sum(a * a) AS z_sum_sq, sum(a) AS pos_sum, count(*) AS pos_n, count(*) AS nz_n
FROM pre WHERE a > 0 GROUP BY 1, 2""",
)
def g3_encoded(spark, sf):
    return encode.encode_slide_stats(fx.tiles(spark, sf), fx.model(spark, sf))


@query(
    "g4_prevalence",
    needs="firing slides",
    d="slide_prevalence case_prevalence",
    sql="""SELECT latent_idx, count(DISTINCT slide_key) AS slides_with_activation, count(DISTINCT case_id) AS cases_with_activation,
  count(DISTINCT slide_key) / (SELECT count(*) FROM slides) AS slide_prevalence,
  count(DISTINCT case_id) / (SELECT count(DISTINCT case_id) FROM slides) AS case_prevalence FROM firing GROUP BY 1""",
)
def g4(spark, sf):
    return analytics.prevalence(firing(spark, sf), fx.slides(spark, sf))


VIEWS["spread"] = (
    "firing",
    """
SELECT latent_idx, -sum(p * ln(p)) AS cohort_entropy, arg_min(cohort, (-n, cohort)) AS top_cohort,
  max(n) / any_value(total) AS top_cohort_share
FROM (SELECT latent_idx, cohort, n, n / sum(n) OVER (PARTITION BY latent_idx) AS p, total FROM (
  SELECT latent_idx, cohort, count(*) AS n FROM firing WHERE cohort <> '' GROUP BY 1, 2)
  JOIN (SELECT latent_idx, count(*) AS total FROM firing GROUP BY 1) USING (latent_idx)) GROUP BY 1""",
)


@query(
    "g5_latent_metrics",
    needs="dense_stats pre dense_slides parents",
    d="""max_activation_global variance_global sparsity_score_global slide_prevalence case_prevalence mean_positive_activation
  max_activation_seen cohort_entropy top_cohort_share""",
    sql="""WITH f AS (SELECT DISTINCT latent_idx, slide_key, case_id, cohort FROM pre WHERE a > 0),
sp AS (SELECT latent_idx, -sum(p * ln(p)) AS e, arg_min(cohort, (-n, cohort)) AS c, max(n) / any_value(total) AS s
  FROM (SELECT latent_idx, cohort, n, n / sum(n) OVER (PARTITION BY latent_idx) AS p, total FROM (
    SELECT latent_idx, cohort, count(*) AS n FROM f WHERE cohort <> '' GROUP BY 1, 2)
    JOIN (SELECT latent_idx, count(*) AS total FROM f GROUP BY 1) USING (latent_idx)) GROUP BY 1),
pv AS (SELECT latent_idx, count(DISTINCT slide_key) / (SELECT count(*) FROM dense_slides) AS ps,
  count(DISTINCT case_id) / (SELECT count(DISTINCT case_id) FROM dense_slides) AS pc FROM f GROUP BY 1),
pos AS (SELECT latent_idx, count(*) AS n, avg(a) AS m FROM pre WHERE a > 0 GROUP BY 1)
SELECT range AS latent_idx, CASE WHEN z_max > 0 THEN 1 ELSE 0 END AS is_alive, CASE WHEN parent IN (1, 4) THEN 'by_parent,top' WHEN range < 10 THEN 'top' ELSE '' END AS selected_strategies,
  coalesce(z_max, 0) AS max_activation_global, coalesce(variance, 0) AS variance_global, coalesce(sparsity, 1) AS sparsity_score_global,
  coalesce(ps, 0) AS slide_prevalence, coalesce(pc, 0) AS case_prevalence, coalesce(pos.n, 0) AS num_tiles_positive,
  coalesce(pos.m, 0) AS mean_positive_activation, coalesce(z_max, 0) AS max_activation_seen, coalesce(e, 0) AS cohort_entropy,
  coalesce(c, '') AS top_cohort, coalesce(s, 0) AS top_cohort_share
FROM range(48) r LEFT JOIN dense_stats ON dense_stats.latent_idx = r.range LEFT JOIN sp ON sp.latent_idx = r.range
LEFT JOIN pv ON pv.latent_idx = r.range LEFT JOIN pos ON pos.latent_idx = r.range LEFT JOIN parents ON parents.latent_idx = r.range""",
)
def g5(spark, sf):
    """One encode pass serves slides and statistics; eight of 48 latents never fire."""
    tiles, model = fx.tiles(spark, sf), fx.model(spark, sf)
    partials = settle(encode.encode_slide_stats(tiles, model))
    n_tiles = tiles.agg(F.count("*").alias("n")).scalar()
    st = stats.finalize_stats(stats.stats_from_slides(partials, n_tiles, 48))
    parents = encode.parent_assignment(encode.coefficients(fx.level2(spark, sf)))
    by_parent = parents.where("parent in (1, 4)").select("latent_idx", F.explode(F.expr("array('top', 'by_parent')")).alias("latent_strategy"))
    low = parents.where("latent_idx < 10 and parent not in (1, 4)").select("latent_idx", F.lit("top").alias("latent_strategy"))
    chosen = by_parent.unionByName(low)
    return analytics.latent_metrics(partials, st, fx.dense_slides(spark, sf), chosen, 48)


@query(
    "g6_positive_mean",
    needs="acts",
    d="mean_positive_activation max_activation_seen",
    sql="""SELECT range AS latent_idx, coalesce(n, 0) AS num_tiles_positive, coalesce(m, 0) AS mean_positive_activation,
  coalesce(z, 0) AS max_activation_seen, CASE WHEN z > 0 THEN 1 ELSE 0 END AS is_alive
FROM range(70) r LEFT JOIN (SELECT latent_idx, count(*) AS n, avg(z) AS m, max(z) AS z FROM acts GROUP BY 1) a ON a.latent_idx = r.range""",
)
def g6(spark, sf):
    out = analytics.latent_metrics(partials(spark, sf), fx.sparse_stats(spark, sf), fx.slides(spark, sf), None, 70)
    return out.select("latent_idx", "num_tiles_positive", "mean_positive_activation", "max_activation_seen", "is_alive")


@query(
    "g7_cohort_counts",
    needs="firing",
    sql="SELECT latent_idx, cohort, count(*) AS firing_slides FROM firing WHERE cohort <> '' GROUP BY 1, 2",
)
def g7(spark, sf):
    return analytics.cohort_counts(firing(spark, sf))


@query("g7_cohort_entropy", needs="spread", d="cohort_entropy", sql="SELECT latent_idx, cohort_entropy FROM spread")
def g7_entropy(spark, sf):
    return analytics.cohort_spread(firing(spark, sf)).select("latent_idx", "cohort_entropy")


@query("g8_top_cohort", needs="spread", d="top_cohort_share", sql="SELECT latent_idx, top_cohort, top_cohort_share FROM spread")
def g8(spark, sf):
    return analytics.cohort_spread(firing(spark, sf)).select("latent_idx", "top_cohort", "top_cohort_share")


@query(
    "g9_cohort_enrichment",
    needs="firing slides selected",
    d="prevalence_in_cohort prevalence_global enrichment_ratio",
    sql="""WITH c AS (SELECT cohort, count(*) AS slides_in_cohort FROM slides WHERE cohort <> '' GROUP BY 1),
g AS (SELECT s.latent_strategy, s.latent_idx, s.latent_group, c.*,
  (SELECT count(*) FROM firing f WHERE f.latent_idx = s.latent_idx AND f.cohort = c.cohort) AS slides_with_activation,
  (SELECT count(*) FROM firing f WHERE f.latent_idx = s.latent_idx) / (SELECT count(*) FROM slides) AS prevalence_global
  FROM selected s CROSS JOIN c)
SELECT latent_strategy, latent_idx, latent_group, cohort, slides_in_cohort, slides_with_activation,
  slides_with_activation / slides_in_cohort AS prevalence_in_cohort, prevalence_global,
  CASE WHEN prevalence_global > 0 THEN slides_with_activation / slides_in_cohort / prevalence_global ELSE 0 END AS enrichment_ratio FROM g""",
)
def g9(spark, sf):
    acts = fx.stored_acts(spark, sf)
    return analytics.cohort_enrichment(firing(spark, sf, acts), fx.slides(spark, sf), fx.selected(spark, sf, acts))


# Case labels from `nation`; a second row per case overwrites the first, some values are blank.
VIEWS["case_labels"] = (
    "",
    """
SELECT 'K' || n_nationkey AS case_id, CASE WHEN n_nationkey % 7 = 0 OR n_regionkey = 4 THEN '' ELSE 'L' || (n_nationkey % 3) END AS subtype,
  CASE WHEN n_regionkey = 4 THEN '' ELSE 'R' || n_regionkey END AS region FROM nation""",
)


def case_labels(spark, sf):
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(
        "n_nationkey", "n_regionkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")
    )
    return rows.selectExpr(
        "concat('k', n_nationkey) as case_id",
        "case when turn = 0 then 'old' when n_nationkey % 7 = 0 or n_regionkey = 4 then '' else concat('L', n_nationkey % 3) end as subtype",
        "case when turn = 0 then 'old' when n_regionkey = 4 then '' else concat('R', n_regionkey) end as region",
        "n_nationkey * 2 + turn as ord",
    )


VIEWS["strong_case"] = (
    "acts slides selected",
    """
SELECT s.latent_strategy, s.latent_idx, s.latent_group, d.case_id,
  greatest(coalesce(max(a.z - 2.6), 0), 0) AS case_score, CASE WHEN max(a.z) > 2.6 THEN 1 ELSE 0 END AS fires
FROM slides d CROSS JOIN selected s
LEFT JOIN acts a ON a.slide_key = d.slide_key AND a.latent_idx = s.latent_idx
GROUP BY 1, 2, 3, 4""",
)


def strong_slide_latent(spark, sf):
    """Slide rows and selection over activations less 2.6; every row goes in."""
    acts = fx.stored_acts(spark, sf)
    chosen = fx.selected(spark, sf, acts)
    return _slide_latent(spark, sf, acts, acts.withColumn("z", F.col("z") - 2.6), chosen), chosen


@query("g11_case_scores", needs="strong_case", d="case_score", sql="SELECT * FROM strong_case")
def g11(spark, sf):
    return analytics.case_scores(strong_slide_latent(spark, sf)[0])


@query(
    "g10_label_enrichment",
    needs="strong_case case_labels slides selected",
    d="prevalence_in_label prevalence_global enrichment_ratio",
    sql="""WITH l AS (SELECT case_id, label_column, label_value FROM case_labels UNPIVOT (label_value FOR label_column IN (subtype, region))
  WHERE case_id IN (SELECT case_id FROM slides)),
v AS (SELECT label_column, label_value, count(*) AS cases_in_label FROM l WHERE label_value <> '' GROUP BY 1, 2),
f AS (SELECT latent_strategy, latent_idx, label_column, label_value FROM strong_case JOIN l USING (case_id) WHERE fires = 1),
g AS (SELECT s.latent_strategy, s.latent_idx, s.latent_group, v.*,
  (SELECT count(*) FROM f WHERE f.latent_strategy = s.latent_strategy AND f.latent_idx = s.latent_idx
    AND f.label_column = v.label_column AND f.label_value = v.label_value) AS cases_with_activation,
  (SELECT count(*) FROM f WHERE f.latent_strategy = s.latent_strategy AND f.latent_idx = s.latent_idx AND f.label_column = v.label_column)
    / (SELECT count(*) FROM l WHERE l.label_column = v.label_column) AS prevalence_global
  FROM selected s CROSS JOIN v)
SELECT *, cases_with_activation / cases_in_label AS prevalence_in_label,
  CASE WHEN prevalence_global > 0 THEN cases_with_activation / cases_in_label / prevalence_global ELSE 0 END AS enrichment_ratio FROM g""",
)
def g10(spark, sf):
    long = analytics.case_labels(case_labels(spark, sf), ["subtype", "region"], "ord")
    slide_stats, chosen = strong_slide_latent(spark, sf)
    return analytics.label_enrichment(slide_stats, fx.slides(spark, sf), long, chosen)


_HIST = """WITH g AS (SELECT latent_strategy, latent_idx, latent_group, max(slide_max_activation) AS m, count(*) AS n_slides,
  sum(fires) AS n_firing_slides FROM slide_latent GROUP BY 1, 2, 3),
u AS (SELECT *, CASE WHEN m > 0 THEN m ELSE 1 END AS upper FROM g),
b AS (SELECT latent_strategy, latent_idx, least(CAST(floor(slide_max_activation / (upper / 16)) AS BIGINT), 15) AS bin, count(*) AS slides
  FROM slide_latent JOIN u USING (latent_strategy, latent_idx) GROUP BY 1, 2, 3),
h AS (SELECT u.latent_strategy, u.latent_idx, u.latent_group, range AS bin, range * (upper / 16) AS bin_lo, (range + 1) * (upper / 16) AS bin_hi,
  coalesce(slides, 0) AS slides, n_slides, n_firing_slides, m AS max_activation
  FROM u CROSS JOIN range(16) r LEFT JOIN b ON b.latent_strategy = u.latent_strategy AND b.latent_idx = u.latent_idx AND b.bin = r.range)"""


@query("g12_histogram_bins", needs="slide_latent", d="bin_lo bin_hi max_activation", sql=f"{_HIST} SELECT * FROM h")
def g12(spark, sf):
    return analytics.histogram_bins(slide_latent(spark, sf), 16)


@query(
    "g12_histograms",
    needs="slide_latent",
    d="max_activation last_edge",
    sql=f"""{_HIST} SELECT latent_strategy, latent_idx, n_slides, n_firing_slides, max_activation,
  string_agg(CAST(slides AS VARCHAR), '|' ORDER BY bin) AS counts, max(bin_hi) AS last_edge FROM h GROUP BY 1, 2, 3, 4, 5""",
)
def g12_packed(spark, sf):
    out = analytics.histograms(slide_latent(spark, sf), 16)
    return out.select(
        "latent_strategy", "latent_idx", "n_slides", "n_firing_slides", "max_activation",
        F.concat_ws("|", F.col("counts").cast("array<string>")).alias("counts"),
        F.element_at("bin_edges", -1).alias("last_edge"),
    )


@query(
    "j15_slide_skeleton",
    needs="slide_latent",
    sql="SELECT latent_strategy, count(*) AS rows, count_if(fires = 0) AS silent, sum(positive_tile_count) AS tiles FROM slide_latent GROUP BY 1",
)
def j15(spark, sf):
    return slide_latent(spark, sf).groupBy("latent_strategy").agg(
        F.count("*").alias("rows"), F.count_if(F.col("fires") == 0).alias("silent"), F.sum("positive_tile_count").alias("tiles")
    )
