"""The given tables read as tiles, weights, activations, slides, labels and registry rows.

Each Spark function has a SQL view of the same content in VIEWS. Whole tables
are used; modulo terms only assign rows to keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentlake.operators.encode import LatentModel
from latentlake.runtime import settle

LATENTS = 40
SPARSE_LATENTS = 64
PARENTS = 8
#: Tile keys that one task makes distinct.
KEY_ROWS = 250_000
D_IN = 64

VIEWS: dict[str, tuple[str, str]] = {}


_SCHEMAS: dict[str, object] = {}


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# --- dense tiles and weights from `embeddings` -------------------------------------------

VIEWS["tiles"] = (
    "",
    """
SELECT 'S' || slide_no AS slide_key, 'K' || case_no AS case_id,
  CASE WHEN case_no % 6 = 5 THEN '' ELSE 'C' || (case_no % 5) END AS cohort,
  CASE WHEN slide_no % 3 = 0 THEN 'seal' ELSE 'uni2' END AS encoder,
  CASE WHEN case_no % 4 = 0 THEN 'test' ELSE 'train' END AS split,
  tile_index, (tile_index % 5) * 256 AS coord_x, (tile_index // 5) * 256 AS coord_y, features, label
FROM (SELECT vec_id // 20 AS slide_no, vec_id // 40 AS case_no, vec_id % 20 AS tile_index,
        embedding AS features, label FROM embeddings)""",
)


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    base = _read(spark, sf, "embeddings").selectExpr(
        "vec_id div 20 as slide_no", "vec_id div 40 as case_no", "vec_id % 20 as tile_index",
        "embedding as features", "label",
    )
    return base.selectExpr(
        "concat('S', slide_no) as slide_key",
        "concat('K', case_no) as case_id",
        "if(case_no % 6 = 5, '', concat('C', case_no % 5)) as cohort",
        "if(slide_no % 3 = 0, 'seal', 'uni2') as encoder",
        "if(case_no % 4 = 0, 'test', 'train') as split",
        "tile_index",
        "cast((tile_index % 5) * 256 as int) as coord_x",
        "cast((tile_index div 5) * 256 as int) as coord_y",
        "features",
        "label",
    )


VIEWS["grid_tiles"] = (
    "tiles",
    """
SELECT * REPLACE (
  CASE WHEN sn % 9 = 7 AND tile_index = 3 THEN 512 WHEN sn % 9 = 4 AND tile_index = 7 THEN coord_x + 13
       ELSE coord_x END AS coord_x,
  CASE WHEN sn % 7 = 3 AND tile_index >= 18 THEN 1024 ELSE coord_y END AS coord_y)
FROM (SELECT *, CAST(substr(slide_key, 2) AS BIGINT) AS sn FROM tiles)""",
)


def grid_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles with some off-grid, duplicated and missing cells."""
    return (
        tiles(spark, sf)
        .withColumn("sn", F.expr("cast(substr(slide_key, 2) as bigint)"))
        .withColumns(
            {
                "coord_x": F.expr(
                    "case when sn % 9 = 7 and tile_index = 3 then 512 "
                    "when sn % 9 = 4 and tile_index = 7 then coord_x + 13 else coord_x end"
                ),
                "coord_y": F.expr("if(sn % 7 = 3 and tile_index >= 18, 1024, coord_y)"),
            }
        )
    )


VIEWS["tile_dims"] = (
    "tiles",
    """
SELECT slide_key, case_id, cohort, split, tile_index, coord_x, coord_y, label,
  CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) - 1 AS dim FROM tiles""",
)
VIEWS["model_dims"] = (
    "",
    """
SELECT label * 4 + vec_id % 4 AS latent_idx, dim, round(avg(x), 6) AS w
FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim
      FROM embeddings) GROUP BY 1, 2""",
)
VIEWS["model"] = (
    "model_dims",
    "SELECT latent_idx, list(w ORDER BY dim) AS w, -0.01 * (latent_idx % 3) AS b FROM model_dims GROUP BY latent_idx",
)
VIEWS["pre"] = (
    "tile_dims model_dims",
    """
SELECT * EXCLUDE (s), s + (-0.01 * (latent_idx % 3)) AS a FROM (
  SELECT t.slide_key, t.case_id, t.cohort, t.split, t.tile_index, t.coord_x, t.coord_y, m.latent_idx,
    sum(t.x * m.w) AS s
  FROM tile_dims t JOIN model_dims m USING (dim) GROUP BY ALL)""",
)
VIEWS["dense"] = ("pre", "SELECT * EXCLUDE (a), a AS z FROM pre WHERE a > 0")
VIEWS["dense_counts"] = ("tiles", "SELECT slide_key, count(*) AS total_tiles FROM tiles GROUP BY 1")
VIEWS["dense_n"] = ("tiles", "SELECT count(*) AS n FROM tiles")
VIEWS["dense_slides"] = (
    "tiles",
    """SELECT DISTINCT slide_key, case_id, cohort, split,
  '/lake/wsi_features/uni2/TCGA/' || cohort || '/h5/' || slide_key || '.h5' AS feature_path FROM tiles""",
)


def encoder(spark: SparkSession, sf: str) -> DataFrame:
    """Latent weights: mean vector of each (label, vec_id mod 4) group of the whole table."""
    dims = _read(spark, sf, "embeddings").select(
        F.expr("cast(label * 4 + vec_id % 4 as bigint)").alias("latent_idx"), F.posexplode("embedding").alias("dim", "x")
    )
    w = dims.groupBy("latent_idx", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("w"))
    packed = w.groupBy("latent_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "w"))), lambda r: r["w"]).alias("w")
    )
    return packed.withColumn("b", -0.01 * (F.col("latent_idx") % 3).cast("double"))


def model(spark: SparkSession, sf: str, **rule) -> LatentModel:
    return LatentModel(encoder(spark, sf), **rule)


def dense_slides(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr("concat('/lake/wsi_features/uni2/TCGA/', cohort, '/h5/', slide_key, '.h5')")
    return tiles(spark, sf).select("slide_key", "case_id", "cohort", "split").distinct().withColumn("feature_path", path)


# Eight parents; the raw coefficient of a latent sums every eighth weight.
VIEWS["level2_dims"] = (
    "model_dims",
    "SELECT latent_idx, dim % 8 AS parent, round(sum(w) * 10, 6) AS raw FROM model_dims GROUP BY 1, 2",
)
VIEWS["parents"] = (
    "level2_dims",
    "SELECT latent_idx, min(parent) AS parent FROM (SELECT *, max(raw) OVER (PARTITION BY latent_idx) AS m FROM level2_dims) WHERE raw = m GROUP BY 1",
)


def level2(spark: SparkSession, sf: str) -> DataFrame:
    """``(latent_idx, coeff array)`` raw coefficients over the parents."""
    cells = (
        encoder(spark, sf)
        .select("latent_idx", F.posexplode("w").alias("dim", "w"))
        .groupBy("latent_idx", (F.col("dim") % PARENTS).alias("parent"))
        .agg(F.round(F.sum("w") * 10, 6).alias("raw"))
    )
    return cells.groupBy("latent_idx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("parent", "raw"))), lambda r: r["raw"]).alias("coeff")
    )


# --- sparse activations from `lineitem` ----------------------------------------------------

VIEWS["acts"] = (
    "",
    """
SELECT *, (tile_index // 8 % 64) * 256 AS coord_x, (tile_index // 512 % 64) * 256 AS coord_y
FROM (SELECT 'S' || l_suppkey AS slide_key, l_orderkey * 8 + l_linenumber AS tile_index,
        l_partkey % 64 AS latent_idx, sqrt(max(l_extendedprice)) / 100 AS z
      FROM lineitem GROUP BY 1, 2, 3)""",
)
VIEWS["sparse_tiles"] = ("acts", "SELECT DISTINCT slide_key, tile_index, coord_x, coord_y FROM acts")
VIEWS["sparse_counts"] = ("sparse_tiles", "SELECT slide_key, count(*) AS total_tiles FROM sparse_tiles GROUP BY 1")
VIEWS["sparse_n"] = ("sparse_tiles", "SELECT count(*) AS n FROM sparse_tiles")
VIEWS["slides"] = (
    "",
    """
SELECT 'S' || s_suppkey AS slide_key, 'K' || s_nationkey AS case_id,
  CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE r_name END AS cohort,
  CASE WHEN s_suppkey % 4 = 0 THEN 'test' ELSE 'train' END AS split,
  '/lake/wsi_features/uni2/TCGA/' || r_name || '/h5/S' || s_suppkey || '.h5' AS feature_path
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)


def acts(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _read(spark, sf, "lineitem").selectExpr(
        "concat('S', l_suppkey) as slide_key", "l_orderkey * 8 + l_linenumber as tile_index",
        "l_partkey % 64 as latent_idx", "l_extendedprice as price",
    )
    z = keyed.groupBy("slide_key", "tile_index", "latent_idx").agg((F.sqrt(F.max("price")) / 100).alias("z"))
    return z.withColumns(
        {
            "coord_x": F.expr("cast((tile_index div 8 % 64) * 256 as int)"),
            "coord_y": F.expr("cast((tile_index div 512 % 64) * 256 as int)"),
        }
    )


def sparse_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return acts(spark, sf).select("slide_key", "tile_index", "coord_x", "coord_y").distinct()


def sparse_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct tile keys straight from the key columns.

    Few keys repeat, so rows are dealt by key first, ``KEY_ROWS`` to a task: combining them before the shuffle would hold a whole split.
    """
    keys = _read(spark, sf, "lineitem").selectExpr(
        "concat('S', l_suppkey) as slide_key", "l_orderkey * 8 + l_linenumber as tile_index"
    )
    tasks = max(spark.sparkContext.defaultParallelism, -(-keys.count() // KEY_ROWS))
    return keys.repartition(tasks, *keys.columns).distinct()


def slides(spark: SparkSession, sf: str) -> DataFrame:
    joined = (
        _read(spark, sf, "supplier")
        .join(_read(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(_read(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return joined.selectExpr(
        "concat('S', s_suppkey) as slide_key",
        "concat('K', s_nationkey) as case_id",
        "if(s_suppkey % 13 = 0, '', r_name) as cohort",
        "if(s_suppkey % 4 = 0, 'test', 'train') as split",
        "concat('/lake/wsi_features/uni2/TCGA/', r_name, '/h5/S', s_suppkey, '.h5') as feature_path",
    )


VIEWS["sparse_parents"] = ("", "SELECT CAST(range AS BIGINT) AS latent_idx, CAST(range % 8 AS BIGINT) AS parent FROM range(64)")


def sparse_parents(spark: SparkSession) -> DataFrame:
    return spark.range(SPARSE_LATENTS).selectExpr("id as latent_idx", "id % 8 as parent")


VIEWS["sparse_stats"] = (
    "acts sparse_n",
    """
SELECT r.range AS latent_idx, n AS n_tiles, coalesce(z_max, 0) AS z_max, coalesce(z_sum, 0) AS z_sum,
  coalesce(z_sum_sq, 0) AS z_sum_sq, coalesce(nnz, 0) AS nnz,
  coalesce(z_sum, 0) / n AS mean,
  greatest(coalesce(z_sum_sq, 0) / n - (coalesce(z_sum, 0) / n) * (coalesce(z_sum, 0) / n), 0) AS variance,
  1.0 - coalesce(nnz, 0) / n AS sparsity
FROM range(64) r CROSS JOIN sparse_n
LEFT JOIN (SELECT latent_idx, max(z) AS z_max, sum(z) AS z_sum, sum(z * z) AS z_sum_sq, count(*) AS nnz
           FROM acts GROUP BY 1) a ON a.latent_idx = r.range""",
)
VIEWS["dense_stats"] = (
    "pre dense_n",
    """
SELECT latent_idx, n AS n_tiles, max(greatest(a, 0)) AS z_max, sum(greatest(a, 0)) AS z_sum,
  sum(greatest(a, 0) * greatest(a, 0)) AS z_sum_sq, count_if(a > 0) AS nnz,
  sum(greatest(a, 0)) / n AS mean,
  greatest(sum(greatest(a, 0) * greatest(a, 0)) / n - pow(sum(greatest(a, 0)) / n, 2), 0) AS variance,
  1.0 - count_if(a > 0) / n AS sparsity
FROM pre CROSS JOIN dense_n GROUP BY latent_idx, n""",
)

# Three strategies with eight latents each over the sparse activations.
VIEWS["selected"] = (
    "sparse_stats",
    """
SELECT latent_strategy, latent_idx, sel_pos, 'selected' AS latent_group FROM (
  SELECT 'top_activation' AS latent_strategy, latent_idx,
    row_number() OVER (ORDER BY z_max DESC, latent_idx DESC) AS sel_pos FROM sparse_stats
  UNION ALL SELECT 'top_variance', latent_idx,
    row_number() OVER (ORDER BY round(variance, 9) DESC, latent_idx DESC) FROM sparse_stats
  UNION ALL SELECT 'top_sparsity', latent_idx,
    row_number() OVER (ORDER BY round(sparsity, 9) DESC, latent_idx DESC) FROM sparse_stats)
WHERE sel_pos <= 8""",
)


def stored_acts(spark: SparkSession, sf: str) -> DataFrame:
    """The activation table written once, for queries that read it several times."""
    return settle(acts(spark, sf))


def sparse_stats(spark: SparkSession, sf: str, stored: DataFrame | None = None) -> DataFrame:
    from latentlake.operators.stats import finalize_stats, latent_stats

    keys = sparse_keys(spark, sf) if stored is None else stored.select("slide_key", "tile_index").distinct()
    hits = acts(spark, sf) if stored is None else stored
    n = keys.agg(F.count("*").alias("n")).scalar()
    stats = finalize_stats(latent_stats(hits, n, SPARSE_LATENTS))
    # fixed precision keeps the order of near-equal statistics the same in every engine
    return stats.withColumns({c: F.round(c, 9) for c in ("variance", "sparsity")})


def selected(spark: SparkSession, sf: str, stored: DataFrame | None = None, n: int = 8) -> DataFrame:
    from functools import reduce

    from latentlake.operators.selection import select_latents

    stats = settle(sparse_stats(spark, sf, stored))
    parts = [
        select_latents(stats, s, n).select(
            F.lit(s).alias("latent_strategy"), "latent_idx", "sel_pos", F.lit("selected").alias("latent_group")
        )
        for s in ("top_activation", "top_variance", "top_sparsity")
    ]
    return settle(reduce(DataFrame.unionByName, parts))


# --- names, registry and labels from `documents` and `labels` --------------------------------

VIEWS["doc_names"] = (
    "",
    """
SELECT doc_id, source, case_barcode, cohort, encoder, quality, toxic, barcode,
  CASE doc_id % 6
    WHEN 0 THEN '/lake/wsi_features/' || encoder || '/TCGA/' || cohort || '/h5/' || barcode || '.h5'
    WHEN 1 THEN '/old/TCGA-' || cohort || '/features_' || encoder || '/' || lower(barcode) || '.a' || doc_id || '.h5'
    WHEN 2 THEN '/old/extracted_features/TCGA-' || cohort || '/' || barcode || '_001.h5'
    WHEN 3 THEN 'loose/' || source || '_' || doc_id || '.v2.SVS'
    WHEN 4 THEN '/x/tcga-' || lower(cohort) || '/' || case_barcode || '.svs'
    ELSE barcode || '.tif' END AS path
FROM (SELECT *, case_barcode || '-01Z-00-DX' || CASE WHEN doc_id % 2 = 0 THEN '1' WHEN doc_id % 3 = 0 THEN 'B' ELSE '2' END AS barcode
  FROM (SELECT d.doc_id, source, upper(lang) AS cohort, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic,
      CASE WHEN toxic = 1 THEN 'uni2' ELSE 'seal' END AS encoder,
      'TCGA-' || chr(CAST(65 + d.doc_id // 2 % 26 AS INTEGER)) || chr(CAST(65 + d.doc_id // 52 % 26 AS INTEGER)) || '-' || lpad(CAST(d.doc_id // 2 % 10000 AS VARCHAR), 4, '0') AS case_barcode
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))""",
)


def doc_names(spark: SparkSession, sf: str) -> DataFrame:
    """Slide-like names over all documents: barcodes, cohort, encoder and a path in one of six forms."""
    docs = _read(spark, sf, "documents").select("doc_id", "source", "lang")
    base = docs.join(_read(spark, sf, "labels"), "doc_id", "left").selectExpr(
        "doc_id", "source", "upper(lang) as cohort",
        "coalesce(quality, -1) as quality", "coalesce(toxic, -1) as toxic",
        "if(toxic = 1, 'uni2', 'seal') as encoder",
        "concat('TCGA-', char(65 + doc_id div 2 % 26), char(65 + doc_id div 52 % 26), '-', "
        "lpad(cast(doc_id div 2 % 10000 as string), 4, '0')) as case_barcode",
    ).selectExpr(
        "*",
        "concat(case_barcode, '-01Z-00-DX', case when doc_id % 2 = 0 then '1' when doc_id % 3 = 0 then 'B' else '2' end) as barcode",
    )
    path = """case doc_id % 6
      when 0 then concat('/lake/wsi_features/', encoder, '/TCGA/', cohort, '/h5/', barcode, '.h5')
      when 1 then concat('/old/TCGA-', cohort, '/features_', encoder, '/', lower(barcode), '.a', doc_id, '.h5')
      when 2 then concat('/old/extracted_features/TCGA-', cohort, '/', barcode, '_001.h5')
      when 3 then concat('loose/', source, '_', doc_id, '.v2.SVS')
      when 4 then concat('/x/tcga-', lower(cohort), '/', case_barcode, '.svs')
      else concat(barcode, '.tif') end as path"""
    return base.selectExpr("doc_id", "source", "case_barcode", "cohort", "encoder", "quality", "toxic", "barcode", path)


# Slide list: the documents of all sources but one, some listed twice. Feature index: every label row,
# some under a second encoder or in a second version.
VIEWS["slide_list"] = (
    "doc_names",
    """
SELECT doc_id * 2 + copy AS ord, source, barcode AS slide_id, barcode || '.svs' AS slide_filename,
  case_barcode AS case_id, 'TCGA' AS dataset, cohort,
  CASE WHEN source = 'src8' THEN '' ELSE '/lake/wsi_slides/TCGA/' || cohort || '/slides/' || barcode
    || CASE WHEN copy = 1 THEN '_b' ELSE '' END || '.SVS' END AS wsi_path
FROM doc_names CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1)
WHERE source <> 'src3' AND (copy = 0 OR (cohort = 'FR' AND quality = 0))""",
)
VIEWS["full_slide_list"] = ("doc_names", VIEWS["slide_list"][1].replace("source <> 'src3' AND ", ""))
VIEWS["feature_list"] = (
    "doc_names",
    """
SELECT ord, source, slide_id, cohort, encoder, '/lake/wsi_features/' || encoder || '/TCGA/' || cohort || '/h5/' || slide_id || sfx || '.h5' AS path
FROM (
  SELECT doc_id * 4 AS ord, source, barcode AS slide_id, cohort, encoder, '' AS sfx
  FROM doc_names WHERE quality >= 0
  UNION ALL SELECT doc_id * 4 + 1, source, barcode, cohort,
    CASE WHEN encoder = 'uni2' THEN 'seal' ELSE 'uni2' END, '' FROM doc_names WHERE quality >= 0 AND cohort = 'DE'
  UNION ALL SELECT doc_id * 4 + 2, source, barcode, cohort, encoder, '.v2' FROM doc_names
    WHERE quality >= 0 AND source = 'src5')""",
)


def slide_list(spark: SparkSession, sf: str) -> DataFrame:
    """Without one source, whose slides the registry then reports as missing."""
    return full_slide_list(spark, sf).where("source <> 'src3'")


def full_slide_list(spark: SparkSession, sf: str) -> DataFrame:
    copies = F.explode(F.expr("if(cohort = 'FR' and quality = 0, array(0, 1), array(0))")).alias("copy")
    return doc_names(spark, sf).select("*", copies).selectExpr(
        "doc_id * 2 + copy as ord", "source",
        "barcode as slide_id",
        "concat(barcode, '.svs') as slide_filename",
        "case_barcode as case_id", "'TCGA' as dataset", "cohort",
        "if(source = 'src8', '', concat('/lake/wsi_slides/TCGA/', cohort, '/slides/', barcode, "
        "if(copy = 1, '_b', ''), '.SVS')) as wsi_path",
    )


def feature_list(spark: SparkSession, sf: str) -> DataFrame:
    copies = F.explode(
        F.expr(
            "filter(array(struct(0 as k, encoder as e, '' as sfx), "
            "if(cohort = 'DE', struct(1 as k, if(encoder = 'uni2', 'seal', 'uni2') as e, '' as sfx), null), "
            "if(source = 'src5', struct(2 as k, encoder as e, '.v2' as sfx), null)), x -> x is not null)"
        )
    ).alias("c")
    return doc_names(spark, sf).where("quality >= 0").select("*", copies).selectExpr(
        "doc_id * 4 + c.k as ord", "source", "barcode as slide_id", "cohort", "c.e as encoder",
        "concat('/lake/wsi_features/', c.e, '/TCGA/', cohort, '/h5/', barcode, c.sfx, '.h5') as path",
    )
