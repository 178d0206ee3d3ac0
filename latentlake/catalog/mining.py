"""Selection, top tiles, diversity, rankings and summaries: H1-H16, G18-G22, J18, J19, K1."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog.base import query
from latentlake.catalog.fixtures import VIEWS
from latentlake.operators import encode, mining, ranking, selection, stats

for _strategy, _score in (("top_activation", "z_max"), ("top_variance", "round(variance, 9)"), ("top_sparsity", "round(sparsity, 9)")):

    def _select(spark, sf, strategy=_strategy):
        return selection.select_latents(fx.sparse_stats(spark, sf), strategy, 12).select("sel_pos", "latent_idx")

    query(
        f"h1_{_strategy}", needs="sparse_stats",
        sql=f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY {_score} DESC, latent_idx DESC) AS sel_pos, latent_idx
  FROM sparse_stats) WHERE sel_pos <= 12""",
    )(_select)


@query(
    "h2_manual_selection",
    needs="sparse_stats",
    d="z_max",
    sql="""SELECT sel_pos, latent_idx, z_max FROM sparse_stats JOIN (VALUES (1, 9), (2, 3), (3, 41)) v(sel_pos, l) ON l = latent_idx""",
)
def h2(spark, sf):
    table = fx.sparse_stats(spark, sf)
    return selection.select_latents(table, "manual", 3, manual=[9, 3, 41]).join(table.select("latent_idx", "z_max"), "latent_idx")


# The greedy loop as a recursion: one latent is taken per step.
_H3 = """WITH RECURSIVE ch AS (SELECT s.latent_idx, s.z_max AS score, p.parent,
    row_number() OVER (PARTITION BY p.parent ORDER BY s.z_max DESC, s.latent_idx) - 1 AS child FROM {stats} s JOIN {parents} p USING (latent_idx)),
par AS (SELECT parent, score AS best, row_number() OVER (ORDER BY score DESC, parent) AS prank FROM ch WHERE child = 0),
cfg AS (SELECT median(best) / {div} AS pen FROM par WHERE prank <= {target}),
cand AS (SELECT ch.*, prank, CASE WHEN prank <= {target} THEN 0 ELSE 1 END AS phase, score - pen * child AS util
  FROM ch JOIN par USING (parent) CROSS JOIN cfg WHERE child < {cap}),
walk AS (
  SELECT 0 AS step, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT step + 1, list_append(taken, (SELECT c.latent_idx FROM cand c
      WHERE NOT list_contains(taken, c.latent_idx)
        AND (c.child = 0 OR list_contains(taken, (SELECT p.latent_idx FROM cand p WHERE p.parent = c.parent AND p.child = c.child - 1)))
      ORDER BY c.phase, CASE WHEN c.child = 0 THEN 0 ELSE 1 END, CASE WHEN c.child = 0 THEN c.prank END,
        c.util DESC, c.score DESC, c.child, c.parent LIMIT 1))
  FROM walk WHERE step < {n})
SELECT row_number() OVER (ORDER BY prank, child) AS sel_pos, latent_idx, parent
FROM cand WHERE list_contains((SELECT taken FROM walk WHERE step = {n}), latent_idx)"""


@query(
    "h3_parent_balanced",
    needs="sparse_stats sparse_parents",
    sql=_H3.format(stats="sparse_stats", parents="sparse_parents", div="8.0", target=5, cap=6, n=20),
)
def h3(spark, sf):
    out = selection.parent_balanced(fx.sparse_stats(spark, sf), fx.sparse_parents(spark), 20)
    return out.select("sel_pos", "latent_idx", "parent")


@query(
    "h3_parent_balanced_overflow",
    needs="dense_stats parents",
    sql=_H3.format(stats="dense_stats", parents="parents", div="4.0", target=2, cap=3, n=14),
)
def h3_dense(spark, sf):
    st = stats.finalize_stats(encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf)))
    parents = encode.parent_assignment(encode.coefficients(fx.level2(spark, sf)))
    out = selection.parent_balanced(st, parents, 14, max_children=3, preferred=2, target=2)
    return out.select("sel_pos", "latent_idx", "parent")


def _top_sql(source: str, n: int, where: str = "true") -> str:
    return f"""SELECT latent_idx, source_rank, slide_key, tile_index, coord_x, coord_y, z FROM (
  SELECT *, row_number() OVER (PARTITION BY latent_idx ORDER BY z DESC, slide_key, tile_index) AS source_rank
  FROM {source} WHERE {where}) WHERE source_rank <= {n}"""


_TOP = ["latent_idx", "source_rank", "slide_key", "tile_index", "coord_x", "coord_y", "z"]
_IN_SELECTED = "latent_idx IN (SELECT latent_idx FROM selected)"


@query("h4_top_tiles", needs="acts selected", d="z", sql=_top_sql("acts", 50, _IN_SELECTED))
def h4(spark, sf):
    acts = fx.stored_acts(spark, sf)
    return mining.top_tiles(acts, fx.selected(spark, sf, acts), 50).select(*_TOP)


@query("h4_top_tiles_encoded", needs="dense", d="z", sql=_top_sql("dense", 10))
def h4_encoded(spark, sf):
    return encode.encode_top(fx.tiles(spark, sf), fx.model(spark, sf), 10).select(*_TOP)


@query(
    "h4_top_tiles_topk_hits",
    needs="pre",
    d="z",
    sql=f"""WITH hits AS (SELECT * EXCLUDE (a), a AS z FROM pre
  QUALIFY row_number() OVER (PARTITION BY slide_key, tile_index ORDER BY abs(a) DESC, latent_idx) <= 4)
{_top_sql('hits', 8)}""",
)
def h4_topk(spark, sf):
    model = fx.model(spark, sf, kind="topk", k=4, mode="magnitude")
    return encode.encode_top(fx.tiles(spark, sf), model, 8).select(*_TOP)


@query(
    "h6_per_slide_cap",
    needs="acts selected",
    d="z",
    sql=f"""WITH t AS ({_top_sql('acts', 300, _IN_SELECTED)})
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY latent_idx, slide_key ORDER BY source_rank) <= 2""",
)
def h6(spark, sf):
    acts = fx.stored_acts(spark, sf)
    top = mining.top_tiles(acts, fx.selected(spark, sf, acts), 300)
    return mining.cap_per_slide(top, 2).select(*_TOP)


def _diverse_sql(source: str, where: str, n: int, cap: int, px: int, topn: int) -> str:
    return f"""WITH RECURSIVE t AS ({_top_sql(source, n, where)}),
seq AS (SELECT *, row_number() OVER (PARTITION BY latent_idx, slide_key ORDER BY source_rank) AS rn FROM t),
walk AS (
  SELECT *, true AS keep, [{{'x': coord_x, 'y': coord_y}}] AS kept FROM seq WHERE rn = 1
  UNION ALL
  SELECT * EXCLUDE (old), CASE WHEN keep THEN list_append(old, {{'x': coord_x, 'y': coord_y}}) ELSE old END AS kept FROM (
    SELECT s.*, len(w.kept) < {cap} AND len(list_filter(w.kept, lambda p : (p.x - s.coord_x) * (p.x - s.coord_x)
      + (p.y - s.coord_y) * (p.y - s.coord_y) < {px * px})) = 0 AS keep, w.kept AS old
    FROM walk w JOIN seq s ON s.latent_idx = w.latent_idx AND s.slide_key = w.slide_key AND s.rn = w.rn + 1))
SELECT * FROM (SELECT latent_idx, row_number() OVER (PARTITION BY latent_idx ORDER BY source_rank) AS source_rank,
  slide_key, tile_index, coord_x, coord_y, z FROM walk WHERE keep) WHERE source_rank <= {topn}"""


@query("h7_diversify", needs="acts selected", d="z", sql=_diverse_sql("acts", _IN_SELECTED, 400, 2, 6000, 100))
def h7(spark, sf):
    acts = fx.stored_acts(spark, sf)
    top = mining.top_tiles(acts, fx.selected(spark, sf, acts), mining.overfetch(100, 4.0))
    return mining.diversify(top, 100, per_slide=2, min_px=6000).select(*_TOP)


@query("h7_diversify_dense", needs="dense", d="z", sql=_diverse_sql("dense", "true", 60, 3, 300, 15))
def h7_dense(spark, sf):
    top = encode.encode_top(fx.tiles(spark, sf), fx.model(spark, sf), mining.overfetch(15, 4.0))
    return mining.diversify(top, 15, per_slide=3, min_px=300).select(*_TOP)


VIEWS["support"] = (
    "acts selected slides",
    f"""
SELECT s.latent_strategy, s.latent_idx, s.latent_group, t.source_rank, t.slide_key, case_id, cohort, t.tile_index,
  t.coord_x, t.coord_y, t.z AS activation, feature_path,
  count(*) OVER w AS slide_support_count, max(t.z) OVER w AS slide_max_activation, avg(t.z) OVER w AS slide_mean_activation
FROM ({_top_sql('acts', 50, _IN_SELECTED)}) t JOIN selected s USING (latent_idx) JOIN slides USING (slide_key)
WINDOW w AS (PARTITION BY latent_strategy, latent_idx, slide_key)""",
)
RUN = {"run_name": "run1", "stage": "relu", "dataset": "TCGA", "encoder": "uni2", "data_split": "test"}


def support(spark, sf):
    """Support rows of three strategies; the union of their latents is mined once."""
    acts = fx.stored_acts(spark, sf)
    chosen = fx.selected(spark, sf, acts)
    top = mining.top_tiles(acts, chosen, 50)
    rows = top.join(F.broadcast(chosen.select("latent_strategy", "latent_idx", "latent_group")), "latent_idx")
    return ranking.slide_support_stats(ranking.support_rows(rows, fx.slides(spark, sf), RUN, root="/lake"))


@query(
    "g18_slide_support_stats",
    needs="support",
    d="slide_max_activation slide_mean_activation",
    sql="""SELECT latent_strategy, latent_idx, source_rank, slide_key, tile_index, slide_support_count, slide_max_activation,
  slide_mean_activation FROM support""",
)
def g18(spark, sf):
    return support(spark, sf).select(
        "latent_strategy", "latent_idx", "source_rank", "slide_key", "tile_index", "slide_support_count",
        "slide_max_activation", "slide_mean_activation",
    )


@query(
    "j19_support_rows",
    needs="support",
    d="activation",
    sql="""SELECT 'run1' AS run_name, 'relu' AS stage, 'uni2' AS encoder, latent_strategy, latent_idx, latent_group, 'support' AS row_kind,
  source_rank, case_id, slide_key, cohort, tile_index, coord_x, coord_y, substr(feature_path, 7) AS feature_relpath,
  slide_key || '.h5' AS feature_h5_name, feature_path AS legacy_h5_path, activation FROM support""",
)
def j19(spark, sf):
    return support(spark, sf).select(
        "run_name", "stage", "encoder", "latent_strategy", "latent_idx", "latent_group", "row_kind", "source_rank",
        "case_id", "slide_key", "cohort", "tile_index", "coord_x", "coord_y", "feature_relpath", "feature_h5_name",
        "legacy_h5_path", "activation",
    )


VIEWS["ranked"] = (
    "support",
    """
WITH g AS (SELECT *, abs(activation - median(activation) OVER (PARTITION BY latent_strategy, latent_idx)) AS gap,
  row_number() OVER (PARTITION BY latent_strategy, latent_idx, slide_key ORDER BY activation DESC, source_rank) AS nth FROM support)
SELECT *, 'max_activation' AS representative_method, activation AS method_score,
  row_number() OVER (PARTITION BY latent_strategy, latent_idx ORDER BY activation DESC, source_rank, slide_key) AS method_rank FROM g
UNION ALL SELECT *, 'median_activation', -gap,
  row_number() OVER (PARTITION BY latent_strategy, latent_idx ORDER BY round(gap, 9), activation DESC, source_rank) FROM g
UNION ALL SELECT *, 'diverse_support', activation,
  row_number() OVER (PARTITION BY latent_strategy, latent_idx ORDER BY nth > 1, activation DESC, source_rank, slide_key) FROM g
UNION ALL SELECT *, 'slide_spread', slide_support_count * 1e6 + slide_max_activation * 1e3 + slide_mean_activation,
  row_number() OVER (PARTITION BY latent_strategy, latent_idx ORDER BY slide_support_count DESC, slide_max_activation DESC,
    slide_mean_activation DESC, slide_key, activation DESC, source_rank) FROM g""",
)
_RANKED = ["latent_strategy", "latent_idx", "representative_method", "method_rank", "source_rank", "slide_key", "tile_index", "method_score"]

for _id, _method in (("h9", "max_activation"), ("h10", "median_activation"), ("h11", "diverse_support"), ("h12", "slide_spread")):

    def _rank(spark, sf, method=_method):
        return ranking.rank_support(support(spark, sf), (method,)).select(*_RANKED)

    query(
        f"{_id}_rank_{_method}", needs="ranked", d="method_score",
        sql=f"SELECT {', '.join(_RANKED)} FROM ranked WHERE representative_method = '{_method}'",
    )(_rank)


@query(
    "k1_all_rankings",
    needs="ranked",
    d="method_score",
    sql=f"SELECT {', '.join(_RANKED)}, 'support' AS row_kind FROM ranked",
)
def k1(spark, sf):
    return ranking.rank_support(support(spark, sf)).select(*_RANKED, "row_kind")


@query(
    "h13_representatives",
    needs="ranked",
    d="method_score",
    sql=f"SELECT {', '.join(_RANKED)}, 'representative' AS row_kind FROM ranked WHERE method_rank = 1",
)
def h13(spark, sf):
    return ranking.representatives(ranking.rank_support(support(spark, sf))).select(*_RANKED, "row_kind")


_GLOBAL = "st.z_max AS max_activation_global, st.variance AS variance_global, st.sparsity AS sparsity_score_global"
_GLOBAL_D = "max_activation_global variance_global sparsity_score_global"


@query(
    "j18_global_stats",
    needs="support sparse_stats",
    d=f"activation {_GLOBAL_D}",
    sql=f"SELECT latent_strategy, latent_idx, source_rank, activation, {_GLOBAL} FROM support JOIN sparse_stats st USING (latent_idx)",
)
def j18(spark, sf):
    out = ranking.attach_global_stats(support(spark, sf), fx.sparse_stats(spark, sf))
    return out.select("latent_strategy", "latent_idx", "source_rank", "activation", *_GLOBAL_D.split())


@query(
    "g19_latent_summary",
    needs="support sparse_stats",
    d=f"activation_max activation_mean activation_p50 activation_p90 {_GLOBAL_D}",
    sql=f"""WITH s AS (SELECT latent_strategy, latent_idx, latent_group, count(*) AS support_tile_count,
  count(DISTINCT slide_key) AS unique_slide_count, count(DISTINCT case_id) AS unique_case_count, max(activation) AS activation_max,
  avg(activation) AS activation_mean, quantile_cont(activation, 0.5) AS activation_p50, quantile_cont(activation, 0.9) AS activation_p90
  FROM support GROUP BY 1, 2, 3)
SELECT s.*, {_GLOBAL} FROM s JOIN sparse_stats st USING (latent_idx)""",
)
def g19(spark, sf):
    out = ranking.latent_summary(support(spark, sf), fx.sparse_stats(spark, sf))
    return out.drop("run_name", "stage", "dataset", "encoder", "data_split")


@query(
    "g20_bundle_summary",
    needs="ranked",
    d="max_activation mean_activation",
    sql="""SELECT count(DISTINCT latent_strategy || '/' || latent_idx) AS total_latent_rows,
  count_if(method_rank = 1) AS total_representative_rows, count(DISTINCT slide_key) AS total_slides, count(DISTINCT case_id) AS total_cases,
  count(DISTINCT feature_path) AS total_feature_files, count(*) AS total_support_rows, max(activation) AS max_activation,
  avg(activation) AS mean_activation FROM ranked""",
)
def g20(spark, sf):
    rows = support(spark, sf)
    ranked = ranking.rank_support(rows)
    summary = ranking.latent_summary(rows, fx.sparse_stats(spark, sf))
    return ranking.bundle_summary(ranking.representatives(ranked), ranked, summary)


@query(
    "g20_bundle_summary_run",
    needs="ranked",
    d="max_activation mean_activation",
    sql="""SELECT 'r1' AS run_name, 'sae' AS stage, 'tcga' AS dataset, '' AS encoder, 'train' AS selection_split, 'test' AS export_split,
  (SELECT string_agg(DISTINCT latent_strategy, ',' ORDER BY latent_strategy) FROM ranked) AS strategies,
  (SELECT string_agg(DISTINCT representative_method, ',' ORDER BY representative_method) FROM ranked) AS methods,
  count(DISTINCT latent_strategy || '/' || latent_idx) AS total_latent_rows, count_if(method_rank = 1) AS total_representative_rows,
  count(DISTINCT slide_key) AS total_slides, count(DISTINCT case_id) AS total_cases, count(DISTINCT feature_path) AS total_feature_files,
  count(*) AS total_support_rows, max(activation) AS max_activation, avg(activation) AS mean_activation FROM ranked""",
)
def g20_run(spark, sf):
    rows = support(spark, sf)
    ranked = ranking.rank_support(rows)
    summary = ranking.latent_summary(rows, fx.sparse_stats(spark, sf))
    run = {"run_name": "r1", "stage": "sae", "dataset": "tcga"}
    out = ranking.bundle_summary(ranking.representatives(ranked), ranked, summary, run, "train", "test")
    lists = {"strategies": "available_latent_strategies", "methods": "available_representative_methods"}
    return out.withColumns({k: F.array_join(v, ",") for k, v in lists.items()}).drop(*lists.values())


# --- viewer tables --------------------------------------------------------------------------

VIEWS["viewer"] = (
    "acts slides sparse_stats",
    f"""
SELECT latent_idx, source_rank AS prototype_rank, z AS activation, case_id, slide_key, tile_index, coord_x, coord_y, feature_path AS h5_path
FROM ({_top_sql('acts', 12)}) JOIN slides USING (slide_key)""",
)


def viewer(spark, sf):
    return ranking.viewer_rows(mining.top_tiles(fx.acts(spark, sf), None, 12), fx.slides(spark, sf), RUN)


@query(
    "h14_viewer_rows",
    needs="viewer",
    d="activation",
    sql="SELECT latent_idx, 'selected' AS latent_group, prototype_rank, activation, case_id, slide_key, tile_index, coord_x, coord_y, h5_path FROM viewer",
)
def h14(spark, sf):
    return viewer(spark, sf).select(
        "latent_idx", "latent_group", "prototype_rank", "activation", "case_id", "slide_key", "tile_index", "coord_x",
        "coord_y", "h5_path",
    )


@query(
    "g21_viewer_latent_summary",
    needs="viewer sparse_stats",
    d=f"best_activation {_GLOBAL_D}",
    sql=f"""SELECT v.*, {_GLOBAL} FROM (SELECT latent_idx, 'selected' AS latent_group, count(*) AS top_tile_count,
  count(DISTINCT slide_key) AS unique_slide_count, max(activation) AS best_activation, arg_min(slide_key, prototype_rank) AS best_slide_key,
  arg_min(case_id, prototype_rank) AS best_case_id, arg_min(tile_index, prototype_rank) AS best_tile_index,
  arg_min(coord_x, prototype_rank) AS best_coord_x, arg_min(coord_y, prototype_rank) AS best_coord_y
  FROM viewer GROUP BY 1) v JOIN sparse_stats st USING (latent_idx)""",
)
def g21(spark, sf):
    return ranking.viewer_latent_summary(viewer(spark, sf), fx.sparse_stats(spark, sf))


@query(
    "g22_viewer_bundle_summary",
    needs="viewer selected",
    d="max_activation mean_activation",
    sql="""SELECT count(DISTINCT latent_idx) AS latent_rows_count, count(*) AS prototype_rows_count, count(DISTINCT slide_key) AS slides_count,
  max(activation) AS max_activation, avg(activation) AS mean_activation,
  (SELECT count(*) FROM selected) AS selected_latents_count FROM viewer""",
)
def g22(spark, sf):
    return ranking.viewer_bundle_summary(viewer(spark, sf), fx.selected(spark, sf))


# --- concepts and orders ----------------------------------------------------------------------

_MARGIN = """WITH m AS (SELECT p.slide_key, p.tile_index, p.latent_idx,
  max(greatest(p.a, 0)) - max(greatest(q.a, 0)) AS margin, max(greatest(p.a, 0)) AS z
  FROM pre p JOIN pre q ON p.slide_key = q.slide_key AND p.tile_index = q.tile_index AND p.latent_idx <> q.latent_idx
  WHERE p.latent_idx = 11 GROUP BY p.slide_key, p.tile_index, p.latent_idx)"""


@query(
    "h16_concept_tiles_margin",
    needs="pre",
    d="concept_score",
    sql=f"{_MARGIN} SELECT slide_key, tile_index, margin AS concept_score FROM m ORDER BY round(margin, 9) DESC, slide_key, tile_index LIMIT 40",
)
def h16(spark, sf):
    return encode.encode_concept(fx.tiles(spark, sf), fx.model(spark, sf), 11, 40)


@query(
    "h16_concept_tiles_blocked",
    needs="pre",
    d="concept_score",
    sql=f"{_MARGIN} SELECT slide_key, tile_index, margin AS concept_score FROM m ORDER BY round(margin, 9) DESC, slide_key, tile_index LIMIT 40",
)
def h16_blocked(spark, sf):
    return encode.encode_concept(fx.tiles(spark, sf), fx.model(spark, sf, block_bytes=7 * fx.D_IN * 8), 11, 40)


@query(
    "h16_concept_tiles_table",
    needs="pre",
    d="concept_score",
    sql=f"{_MARGIN} SELECT slide_key, tile_index, margin AS concept_score FROM m ORDER BY round(margin, 9) DESC, slide_key, tile_index LIMIT 40",
)
def h16_table(spark, sf):
    tiles = fx.tiles(spark, sf)
    hits = encode.encode_hits(tiles, fx.model(spark, sf))
    return mining.concept_tiles(hits, 11, 40, fx.LATENTS, tiles=tiles)


@query(
    "h16_concept_tiles_value",
    needs="pre",
    d="concept_score",
    sql=f"{_MARGIN} SELECT slide_key, tile_index, z AS concept_score FROM m ORDER BY round(z, 9) DESC, slide_key, tile_index LIMIT 40",
)
def h16_value(spark, sf):
    return encode.encode_concept(fx.tiles(spark, sf), fx.model(spark, sf), 11, 40, use_margin=False)


@query(
    "h19_latent_order",
    needs="selected sparse_stats",
    sql="""SELECT latent_idx, row_number() OVER (ORDER BY sel_pos NULLS LAST, latent_idx) AS out_pos
FROM sparse_stats LEFT JOIN (SELECT * FROM selected WHERE latent_strategy = 'top_activation') USING (latent_idx)""",
)
def h19(spark, sf):
    chosen = fx.selected(spark, sf).where("latent_strategy = 'top_activation'")
    return selection.latent_order(fx.sparse_stats(spark, sf).select("latent_idx"), chosen)


@query(
    "j16_selected_strategies",
    needs="selected",
    sql="SELECT latent_idx, string_agg(latent_strategy, ',' ORDER BY latent_strategy) AS selected_strategies FROM selected GROUP BY 1",
)
def j16(spark, sf):
    return selection.selected_map(fx.selected(spark, sf))


@query("k3_selected_union", needs="selected", sql="SELECT DISTINCT latent_idx FROM selected")
def k3(spark, sf):
    return selection.selected_union(fx.selected(spark, sf))
