"""Registry, path resolution and materialisation: J1-J13, J17, K2-K6, G32."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog import mining as mining_catalog
from latentlake.catalog.base import query
from latentlake.catalog.fixtures import VIEWS
from latentlake.operators import materialize, ranking, registry, resolve
from latentlake.runtime import settle

VIEWS["reg"] = (
    "slide_list feature_list",
    """
SELECT coalesce(s.slide_id, f.slide_id) AS slide_id, coalesce(listed, 0) AS listed, f.slide_id IS NOT NULL AS has_feature,
  coalesce(case_id, regexp_extract(f.slide_id, '^(TCGA-[A-Z]{2}-[0-9]{4})', 1)) AS case_id, 'TCGA' AS dataset, coalesce(cohort, '') AS cohort,
  coalesce(slide_filename, '') AS slide_filename, coalesce(wsi_path, '') AS wsi_path,
  coalesce(uni_path, '') AS uni_path, coalesce(seal_path, '') AS seal_path
FROM (SELECT slide_id, count(*) AS listed, min(case_id) AS case_id, min(cohort) AS cohort, min(slide_filename) AS slide_filename,
  min(wsi_path) AS wsi_path FROM slide_list GROUP BY 1) s
FULL OUTER JOIN (SELECT slide_id, arg_max(path, ord) FILTER (encoder = 'uni2') AS uni_path,
  arg_max(path, ord) FILTER (encoder = 'seal') AS seal_path FROM feature_list GROUP BY 1) f ON s.slide_id = f.slide_id""",
)
_COLS = "slide_id, case_id, dataset, cohort, slide_filename, wsi_path, uni_path, seal_path"


def _tables(spark, sf):
    return registry.load_slides(fx.slide_list(spark, sf)), registry.load_features(fx.feature_list(spark, sf))


@query("j1_registry_mapping", needs="reg", sql=f"SELECT {_COLS} FROM reg WHERE listed <= 1")
def j1(spark, sf):
    return registry.registry(*_tables(spark, sf))[0].drop("gigapath_path", "virchow2_path")


@query("j2_missing_slides", needs="reg", sql=f"SELECT {_COLS} FROM reg WHERE listed = 0 AND has_feature")
def j2(spark, sf):
    return registry.registry(*_tables(spark, sf))[1]


@query("j3_missing_features", needs="reg", sql=f"SELECT {_COLS} FROM reg WHERE listed = 1 AND NOT has_feature")
def j3(spark, sf):
    return registry.registry(*_tables(spark, sf))[2]


@query(
    "j4_ambiguous_slides",
    needs="full_slide_list",
    sql="""SELECT slide_id, count(*) AS candidate_count, coalesce(string_agg(nullif(wsi_path, ''), '|' ORDER BY ord), '') AS candidate_paths
FROM full_slide_list GROUP BY 1 HAVING count(*) > 1""",
)
def j4(spark, sf):
    return registry.registry(registry.load_slides(fx.full_slide_list(spark, sf)), registry.load_features(fx.feature_list(spark, sf)))[3]


@query(
    "j5_encoder_paths",
    needs="feature_list",
    sql="""SELECT slide_id, coalesce(arg_max(path, ord) FILTER (encoder = 'uni2'), '') AS uni_path,
  coalesce(arg_max(path, ord) FILTER (encoder = 'seal'), '') AS seal_path, '' AS gigapath_path, '' AS virchow2_path FROM feature_list GROUP BY 1""",
)
def j5(spark, sf):
    return registry.encoder_paths(_tables(spark, sf)[1])


@query(
    "k4_registry_counts",
    needs="reg slide_list feature_list",
    sql="""SELECT (SELECT count(*) FROM slide_list) AS slides, (SELECT count(*) FROM feature_list) AS features,
  count_if(listed <= 1) AS mapping_rows, count_if(listed = 0 AND has_feature) AS missing_slides,
  count_if(listed = 1 AND NOT has_feature) AS missing_features, count_if(listed > 1) AS ambiguous_slides FROM reg""",
)
def k4(spark, sf):
    return registry.registry_counts(*_tables(spark, sf))


@query(
    "j6_slide_upsert",
    needs="slide_list feature_list",
    sql="""WITH e AS (SELECT * FROM slide_list QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY ord DESC) = 1),
n AS (SELECT DISTINCT slide_id FROM feature_list)
SELECT coalesce(e.slide_id, n.slide_id) AS slide_id, coalesce(slide_filename, '') AS slide_filename,
  coalesce(case_id, regexp_extract(n.slide_id, '^(TCGA-[A-Z]{2}-[0-9]{4})', 1)) AS case_id, 'TCGA' AS dataset,
  coalesce(cohort, 'NEW') AS cohort, coalesce(wsi_path, '') AS wsi_path FROM e FULL OUTER JOIN n ON e.slide_id = n.slide_id""",
)
def j6(spark, sf):
    return registry.upsert_slides(fx.slide_list(spark, sf), fx.feature_list(spark, sf).select(F.col("path").alias("slide_id")), "NEW")


@query(
    "j7_load_slides",
    needs="full_slide_list",
    sql="""SELECT slide_id, slide_filename, slide_id[1:12] AS case_id, 'PROJ' AS dataset, cohort, wsi_path,
  CASE WHEN wsi_path = '' THEN '' ELSE '.svs' END AS wsi_ext FROM full_slide_list""",
)
def j7_slides(spark, sf):
    """Rows without case and dataset columns get defaults; half the ids come from the file name."""
    raw = fx.full_slide_list(spark, sf).drop("case_id", "dataset").withColumn("slide_id", F.expr("if(ord % 4 = 0, '', lower(slide_id))"))
    return registry.load_slides(raw, "proj").drop("ord")


@query(
    "j7_load_features",
    needs="feature_list",
    sql="""SELECT slide_id, slide_id[1:12] AS case_id, 'TCGA' AS dataset, cohort, encoder, path AS feature_path, '.h5' AS feature_ext FROM feature_list""",
)
def j7_features(spark, sf):
    raw = fx.feature_list(spark, sf).withColumn("slide_id", F.expr("if(ord % 8 = 0, '', slide_id)"))
    return registry.load_features(raw).drop("ord")


# --- resolution -------------------------------------------------------------------------------

# Files that exist: slides and features of most sources, some slides under another name.
VIEWS["listing"] = (
    "slide_list feature_list",
    """
SELECT wsi_path AS path FROM slide_list WHERE wsi_path <> '' AND source NOT IN ('src1', 'src2')
UNION SELECT '/lake/wsi_slides/TCGA/' || cohort || '/slides/' || slide_filename FROM slide_list WHERE source IN ('src1', 'src8')
UNION SELECT '/lake/wsi_slides/TCGA/' || cohort || '/slides/' || slide_id || '.x.ndpi' FROM slide_list WHERE source = 'src2'
UNION SELECT path FROM feature_list WHERE source <> 'src4'""",
)
VIEWS["requests"] = (
    "doc_names",
    """
SELECT doc_id, barcode AS slide_key, encoder, case_barcode AS case_id,
  CASE WHEN cohort = 'ES' THEN '' ELSE 'wsi_features/' || encoder || '/TCGA/' || cohort || '/h5/' || barcode
    || CASE WHEN cohort = 'FR' THEN '_gone' ELSE '' END || '.h5' END AS feature_relpath FROM doc_names""",
)


def listing(spark, sf):
    s = fx.slide_list(spark, sf)
    folder = "concat('/lake/wsi_slides/TCGA/', cohort, '/slides/', "
    parts = [
        s.where("wsi_path <> '' and source not in ('src1', 'src2')").selectExpr("wsi_path as path"),
        s.where("source in ('src1', 'src8')").selectExpr(f"{folder} slide_filename) as path"),
        s.where("source = 'src2'").selectExpr(f"{folder} slide_id, '.x.ndpi') as path"),
        fx.feature_list(spark, sf).where("source <> 'src4'").select("path"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def requests(spark, sf):
    return fx.doc_names(spark, sf).selectExpr(
        "doc_id", "barcode as slide_key", "encoder", "case_barcode as case_id",
        "if(cohort = 'ES', '', concat('wsi_features/', encoder, '/TCGA/', cohort, '/h5/', barcode, "
        "if(cohort = 'FR', '_gone', ''), '.h5')) as feature_relpath",
    )


VIEWS["res_feature"] = (
    "requests reg listing feature_list",
    """
SELECT r.*, coalesce(p1.path, p2.path, p3.path, '') AS local_feature_path,
  CASE WHEN p1.path IS NOT NULL THEN 'relpath' WHEN p2.path IS NOT NULL THEN 'mapping' WHEN p3.path IS NOT NULL THEN 'features' ELSE '' END AS feature_source
FROM requests r
LEFT JOIN listing p1 ON r.feature_relpath <> '' AND p1.path = '/lake/' || r.feature_relpath
LEFT JOIN reg m ON m.slide_id = r.slide_key AND m.listed <= 1
LEFT JOIN listing p2 ON p2.path = CASE r.encoder WHEN 'uni2' THEN m.uni_path ELSE m.seal_path END
LEFT JOIN (SELECT slide_id, encoder, arg_min(path, ord) AS path FROM feature_list GROUP BY 1, 2) f ON f.slide_id = r.slide_key AND f.encoder = r.encoder
LEFT JOIN listing p3 ON p3.path = f.path""",
)
VIEWS["res_slide"] = (
    "requests reg listing",
    """
SELECT r.doc_id, r.slide_key, coalesce(p1.path, p2.path, g.path, '') AS local_slide_path
FROM requests r LEFT JOIN reg m ON m.slide_id = r.slide_key AND m.listed <= 1
LEFT JOIN listing p1 ON m.wsi_path <> '' AND p1.path = m.wsi_path
LEFT JOIN listing p2 ON m.cohort <> '' AND m.slide_filename <> '' AND p2.path = '/lake/wsi_slides/TCGA/' || m.cohort || '/slides/' || m.slide_filename
LEFT JOIN (SELECT m.slide_id, min(l.path) AS path FROM reg m JOIN listing l
  ON starts_with(l.path, '/lake/wsi_slides/TCGA/' || m.cohort || '/slides/' || m.slide_id || '.') WHERE m.cohort <> '' GROUP BY 1) g ON g.slide_id = m.slide_id""",
)


@query("j9_resolve_features", needs="res_feature", sql="SELECT doc_id, slide_key, local_feature_path, feature_source FROM res_feature")
def j9(spark, sf):
    slides, features = _tables(spark, sf)
    mapping = registry.registry(slides, features)[0]
    out = resolve.resolve_features(requests(spark, sf), mapping, features, listing(spark, sf), "/lake")
    return out.select("doc_id", "slide_key", "local_feature_path", "feature_source")


@query("j10_resolve_slides", needs="res_slide", sql="SELECT doc_id, slide_key, local_slide_path FROM res_slide")
def j10(spark, sf):
    mapping = registry.registry(*_tables(spark, sf))[0]
    out = resolve.resolve_slides(requests(spark, sf), mapping, listing(spark, sf), "/lake")
    return out.select("doc_id", "slide_key", "local_slide_path")


@query(
    "j11_remap_paths",
    needs="doc_names",
    sql="""WITH l AS (
  SELECT path AS f FROM doc_names WHERE source IN ('src0', 'src6')
  UNION SELECT '/lake/wsi_features/seal/TCGA/' || cohort || '/h5/' || barcode || '.h5' FROM doc_names WHERE cohort = 'DE'
  UNION SELECT '/lake/wsi_features/uni2/TCGA/' || cohort || '/h5/' || barcode || '.h5' FROM doc_names WHERE source = 'src9'
  UNION SELECT '/store/TCGA-' || cohort || '/features/' || barcode || '.h5' FROM doc_names WHERE source IN ('src10', 'src11')
  UNION SELECT '/lake/wsi_features/gigapath/TCGA/' || cohort || '/h5/' || barcode || '_v3.h5' FROM doc_names WHERE source IN ('src12', 'src13')
  UNION SELECT '/lake/wsi_features/virchow2/TCGA/Z' || (doc_id % 3) || '/h5/' || regexp_extract(path, 'loose/(.*)[.]SVS$', 1) || '_x.h5' FROM doc_names WHERE path LIKE 'loose/%' AND source IN ('src15', 'src16')),
n AS (SELECT doc_id, path, cohort, barcode, encoder, doc_id % 6 AS form, CASE doc_id % 6 WHEN 0 THEN [barcode]
    WHEN 1 THEN [lower(barcode) || '.a' || doc_id, lower(barcode)] WHEN 2 THEN [barcode || '_001', barcode]
    WHEN 3 THEN [regexp_extract(path, 'loose/(.*)[.]SVS$', 1)] WHEN 4 THEN [case_barcode] ELSE [barcode] END AS names0 FROM doc_names),
w AS (SELECT *, CASE WHEN form IN (0, 2) AND barcode LIKE '%DXB' THEN list_append(names0, left(barcode, len(barcode) - 1) || '2') ELSE names0 END AS names,
  CASE form WHEN 0 THEN barcode[6:] || '.H5' WHEN 3 THEN '*' WHEN 5 THEN barcode[6:] || '.TIF' ELSE cohort END AS coh,
  CASE form WHEN 3 THEN '.SVS' WHEN 4 THEN '.svs' WHEN 5 THEN '.tif' ELSE '.h5' END AS ext,
  CASE WHEN form IN (0, 1) AND encoder = 'seal' THEN ['seal', 'uni2', 'gigapath', 'virchow2'] ELSE ['uni2', 'seal', 'gigapath', 'virchow2'] END AS encs FROM n),
c AS (SELECT path, -1 AS o, path AS f, '' AS dir, '' AS stem, form FROM w
  UNION ALL SELECT path, e * 10 + k, '/lake/wsi_features/' || encs[e] || '/TCGA/' || coh || '/h5/' || names[k] || ext,
    '/lake/wsi_features/' || encs[e] || '/TCGA/' || coh || '/h5/', names[k], form FROM w, range(1, 5) a(e), range(1, 4) b(k) WHERE k <= len(names)
  UNION ALL SELECT path, 1000 + d * 10 + k, '/store/TCGA-' || cohort || '/' || ['features_uni2/', 'features/', ''][d] || names[k] || '.h5',
    '/store/TCGA-' || cohort || '/' || ['features_uni2/', 'features/', ''][d], names[k], form
    FROM w, range(1, 4) a(d), range(1, 4) b(k) WHERE k <= len(names) AND form = 2),
ex AS (SELECT c.path, arg_min(c.f, o) AS hit FROM c JOIN l ON l.f = c.f GROUP BY 1),
gl AS (SELECT path, arg_min(f, (o, f <> dir || stem || '.h5', f)) AS hit FROM (
  SELECT c.path, c.o, c.dir, c.stem, l.f FROM c JOIN l ON o > 0 AND form <> 3 AND starts_with(l.f, dir || stem) AND NOT contains(substr(l.f, len(dir) + 1), '/')
  UNION ALL SELECT c.path, c.o, c.dir, c.stem, l.f FROM c JOIN l ON o > 0 AND form = 3 AND regexp_extract(l.f, '[^/]*$') LIKE replace(stem, '_', '$_') || '%' ESCAPE '$'
    AND regexp_replace(l.f, '/TCGA/[^/]+/h5/[^/]*$', '/TCGA/*/h5/') = dir) GROUP BY 1)
SELECT w.path, coalesce(ex.hit, gl.hit, w.path) AS resolved,
  CASE WHEN ex.hit = w.path THEN 'exact' WHEN ex.hit IS NOT NULL THEN 'candidate' WHEN gl.hit IS NOT NULL THEN 'prefix' ELSE 'unresolved' END AS how
FROM w LEFT JOIN ex ON ex.path = w.path LEFT JOIN gl ON gl.path = w.path""",
)
def j11(spark, sf):
    d = settle(fx.doc_names(spark, sf))
    files = [
        d.where("source in ('src0', 'src6')").select("path"),
        d.where("cohort = 'DE'").selectExpr("concat('/lake/wsi_features/seal/TCGA/', cohort, '/h5/', barcode, '.h5') as path"),
        d.where("source = 'src9'").selectExpr("concat('/lake/wsi_features/uni2/TCGA/', cohort, '/h5/', barcode, '.h5') as path"),
        d.where("source in ('src10', 'src11')").selectExpr("concat('/store/TCGA-', cohort, '/features/', barcode, '.h5') as path"),
        d.where("source in ('src12', 'src13')").selectExpr("concat('/lake/wsi_features/gigapath/TCGA/', cohort, '/h5/', barcode, '_v3.h5') as path"),
    ]
    loose = "regexp_extract(path, 'loose/(.*)[.]SVS$', 1)"
    files.append(
        d.where("path like 'loose/%' and source in ('src15', 'src16')").selectExpr(f"concat('/lake/wsi_features/virchow2/TCGA/Z', doc_id % 3, '/h5/', {loose}, '_x.h5') as path")
    )
    stored = files[0]
    for part in files[1:]:
        stored = stored.unionByName(part)
    return resolve.remap_paths(d, settle(stored.distinct()), ["/lake"], ("/store",))


# --- materialisation --------------------------------------------------------------------------


def _bundle_rows(spark, sf):
    """Representative and support rows whose slides are the dense fixture's tiles."""
    base = mining_catalog.support(spark, sf).withColumn("tile_index", F.expr("tile_index % 24"))
    ranked = settle(ranking.rank_support(base))
    order = ["latent_strategy", "latent_idx", "representative_method"]
    return materialize.bundle_rows(ranking.representatives(ranked), ranked, order)


VIEWS["bundle_rows"] = (
    "ranked",
    """
SELECT *, row_number() OVER (ORDER BY part, latent_strategy, latent_idx, representative_method, method_rank) - 1 AS row_pos FROM (
  SELECT *, 'representative' AS row_kind, 0 AS part FROM ranked WHERE method_rank = 1
  UNION ALL SELECT *, 'support', 1 FROM ranked)""",
)


@query(
    "k2_bundle_rows",
    needs="bundle_rows",
    sql="SELECT row_pos, row_kind, latent_strategy, latent_idx, representative_method, method_rank, slide_key FROM bundle_rows",
)
def k2(spark, sf):
    return _bundle_rows(spark, sf).select(
        "row_pos", "row_kind", "latent_strategy", "latent_idx", "representative_method", "method_rank", "slide_key"
    )


# Feature files exist for slides present in both fixtures; a slide file for all but each fifth slide.
VIEWS["mat_rows"] = (
    "bundle_rows tiles",
    """
SELECT row_pos, slide_key, tile_index % 24 AS tile_index, case_id, coord_x, coord_y,
  CASE WHEN slide_key IN (SELECT slide_key FROM tiles) THEN feature_path ELSE '' END AS local_feature_path,
  CASE WHEN CAST(substr(slide_key, 2) AS BIGINT) % 5 = 0 THEN '' ELSE '/s/' || slide_key END AS local_slide_path FROM bundle_rows""",
)
VIEWS["mat_vectors"] = (
    "mat_rows tiles",
    """
SELECT local_feature_path, slide_key, tile_index, row_number() OVER (ORDER BY min(row_pos)) - 1 AS feature_vector_row
FROM mat_rows JOIN tiles USING (slide_key, tile_index) WHERE local_feature_path <> '' GROUP BY 1, 2, 3""",
)
VIEWS["mat_final"] = (
    "mat_rows mat_vectors",
    """
SELECT m.*, coalesce(feature_vector_row, -1) AS feature_vector_row,
  coalesce(nullif(concat_ws('+', CASE WHEN local_feature_path = '' THEN 'missing_feature' END, CASE WHEN local_slide_path = '' THEN 'missing_slide' END,
    CASE WHEN local_feature_path <> '' AND feature_vector_row IS NULL THEN 'feature_error' END), ''), 'ok') AS status
FROM mat_rows m LEFT JOIN mat_vectors USING (local_feature_path, slide_key, tile_index)""",
)


def _materialized(spark, sf):
    tiles = fx.tiles(spark, sf)
    have = tiles.select("slide_key").distinct().withColumn("have", F.lit(True))
    rows = _bundle_rows(spark, sf).join(have, "slide_key", "left").withColumns(
        {
            "local_feature_path": F.expr("if(have, legacy_h5_path, '')"),
            "local_slide_path": F.expr("if(cast(substr(slide_key, 2) as bigint) % 5 = 0, '', concat('/s/', slide_key))"),
        }
    )
    return materialize.materialize(settle(rows.drop("have")), tiles)


@query(
    "j12_materialize",
    needs="mat_final",
    sql="SELECT row_pos, slide_key, tile_index, local_feature_path, feature_vector_row, status FROM mat_final",
)
def j12(spark, sf):
    return _materialized(spark, sf)[0].select(
        "row_pos", "slide_key", "tile_index", "local_feature_path", "feature_vector_row", "status"
    )


@query(
    "j13_vector_rows",
    needs="mat_vectors tile_dims",
    d="norm",
    sql="""SELECT v.feature_vector_row, v.local_feature_path, v.slide_key, v.tile_index, sqrt(sum(x * x)) AS norm
FROM mat_vectors v JOIN tile_dims USING (slide_key, tile_index) GROUP BY 1, 2, 3, 4""",
)
def j13(spark, sf):
    norm = F.sqrt(F.expr("aggregate(features, 0D, (acc, x) -> acc + double(x) * double(x))"))
    return _materialized(spark, sf)[1].select(
        "feature_vector_row", "local_feature_path", "slide_key", "tile_index", norm.alias("norm")
    )


@query(
    "g32_materialize_summary",
    needs="mat_final",
    sql="""SELECT count(*) AS rows_total, count_if(feature_vector_row >= 0) AS rows_with_feature_vector,
  count_if(contains(status, 'missing_feature')) AS rows_missing_feature, count_if(contains(status, 'missing_slide')) AS rows_missing_slide,
  count_if(contains(status, 'feature_error')) AS rows_feature_error,
  count(DISTINCT CASE WHEN feature_vector_row >= 0 THEN feature_vector_row END) AS unique_feature_vectors FROM mat_final""",
)
def g32(spark, sf):
    return materialize.materialize_summary(_materialized(spark, sf)[0])


@query(
    "j17_viewer_resolve",
    needs="res_slide reg requests",
    sql="""SELECT r.doc_id, r.slide_key, local_slide_path AS slide_path, coalesce(m.cohort, '') AS mapping_cohort,
  CASE WHEN local_slide_path = '' THEN 'missing_slide' ELSE 'ok' END AS status
FROM requests r JOIN res_slide s USING (doc_id) LEFT JOIN reg m ON m.slide_id = r.slide_key AND m.listed <= 1""",
)
def j17(spark, sf):
    mapping = registry.registry(*_tables(spark, sf))[0]
    rows = requests(spark, sf).select("doc_id", "slide_key")
    resolved = resolve.resolve_slides(rows.select("slide_key").distinct(), mapping, listing(spark, sf), "/lake")
    out = materialize.viewer_resolve(rows, resolved, mapping)
    return out.select("doc_id", "slide_key", "slide_path", "mapping_cohort", "status")


@query(
    "k5_dedupe_paths",
    needs="doc_names",
    sql="SELECT DISTINCT cohort AS project, regexp_replace(path, '[0-9]+', '', 'g') AS path FROM doc_names",
)
def k5(spark, sf):
    rows = fx.doc_names(spark, sf).select(F.col("cohort").alias("project"), F.regexp_replace("path", "[0-9]+", "").alias("path"))
    return registry.dedupe_paths(rows)


@query(
    "k6_validate",
    needs="tiles",
    sql="""WITH b AS (SELECT DISTINCT slide_key, CAST(substr(slide_key, 2) AS BIGINT) % 8 AS r FROM tiles)
SELECT 'error' AS severity, 'unreadable_features' AS kind, slide_key AS subject FROM b WHERE r IN (1, 3, 5, 6)
UNION ALL SELECT 'warning', 'missing_encoder', unnest(['gigapath', 'virchow2'])
UNION ALL SELECT DISTINCT 'warning', 'missing_slide_list', cohort FROM tiles WHERE cohort NOT IN ('C1', 'C3')""",
)
def k6(spark, sf):
    from latentlake.catalog.stats import _damaged

    lists = fx.tiles(spark, sf).where("cohort in ('C1', 'C3')").select("cohort")
    return registry.validate(lists, _damaged(spark, sf), 64)


@query(
    "k6_validate_files",
    needs="tiles",
    sql="""WITH c AS (SELECT DISTINCT encoder, cohort FROM tiles WHERE cohort <> ''),
i AS (SELECT 'error' AS severity, 'missing_folder' AS kind, '/lake/' || f AS subject FROM (SELECT unnest(['metadata/indexes', 'metadata/splits']) AS f)
UNION ALL SELECT 'warning', 'missing_encoder_folder', '/lake/wsi_features/' || e || '/TCGA' FROM (SELECT unnest(['gigapath', 'virchow2']) AS e)
UNION ALL SELECT 'warning', 'missing_index', '/lake/wsi_features/' || encoder || '/TCGA/' || cohort || '/index.csv' FROM c WHERE cohort NOT IN ('C1', 'C3')
UNION ALL SELECT 'error', 'missing_h5_folder', '/lake/wsi_features/' || encoder || '/TCGA/' || cohort || '-old/h5' FROM c WHERE cohort = 'C2')
SELECT * FROM i""",
)
def k6_files(spark, sf):
    return registry.validate_files(_lake_files(spark, sf), "/lake")


def _lake_files(spark, sf):
    """Feature files of all slides, indexes of two cohorts, cohort folders without features, and files of three other folders."""
    slides = fx.tiles(spark, sf).where("cohort <> ''").select("slide_key", "encoder", "cohort").distinct()
    base = "'/lake/wsi_features/', encoder, '/TCGA/', cohort"
    return (
        slides.selectExpr(f"concat({base}, '/h5/', slide_key, '.h5') as path")
        .unionByName(slides.where("cohort in ('C1', 'C3')").selectExpr(f"concat({base}, '/index.csv') as path").distinct())
        .unionByName(slides.where("cohort = 'C2'").selectExpr(f"concat({base}, '-old/index.csv') as path").distinct())
        .unionByName(slides.selectExpr("concat('/lake/wsi_slides/TCGA/', cohort, '/slides/', slide_key, '.svs') as path"))
        .unionByName(slides.selectExpr("concat('/lake/metadata/manifests/', cohort, '.csv') as path").distinct())
        .unionByName(slides.selectExpr("concat('/lake/registry/', encoder, '.csv') as path").distinct())
        .unionByName(slides.selectExpr("concat('/elsewhere/metadata/splits/', encoder, '.csv') as path").distinct())
    )


@query(
    "k6_validation_summary",
    needs="tiles",
    sql="""WITH b AS (SELECT DISTINCT slide_key, CAST(substr(slide_key, 2) AS BIGINT) % 8 AS r FROM tiles)
SELECT count_if(r NOT IN (1, 3, 5, 6)) AS validated_feature_files, count_if(r IN (1, 3, 5, 6)) AS errors,
  (SELECT 2 + count(DISTINCT cohort) FROM tiles WHERE cohort NOT IN ('C1', 'C3')) AS warnings, count_if(r IN (1, 3, 5, 6)) = 0 AS valid FROM b""",
)
def k6_summary(spark, sf):
    from latentlake.catalog.stats import _damaged

    lists, tiles = fx.tiles(spark, sf).where("cohort in ('C1', 'C3')").select("cohort"), _damaged(spark, sf)
    rows = settle(registry.health(tiles, 64)[0])
    return registry.validation_summary(registry.validate(lists, tiles, 64, rows=rows), rows)
