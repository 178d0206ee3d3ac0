"""Scans, sources, sinks and filters: A1-A15, C1-C9."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog.base import query
from latentlake.operators import filters, mining, pooling, registry
from latentlake.runtime import scratch_path
from latentlake.sources import readers, writers


@query(
    "a1_tile_scan",
    needs="tiles",
    d="first_value",
    sql="""SELECT slide_key, tile_index, coord_x, coord_y, len(features) AS feature_dim,
  CAST(features[1] AS DOUBLE) AS first_value FROM tiles WHERE encoder = 'uni2' AND split = 'train'""",
)
def a1(spark, sf):
    path = scratch_path(spark, "tiles")
    fx.tiles(spark, sf).drop("label").write.partitionBy("encoder", "split").parquet(path)
    tiles = readers.read_tiles(spark, path, encoder="uni2", split="train")
    return tiles.select(
        "slide_key", "tile_index", "coord_x", "coord_y", F.size("features").alias("feature_dim"),
        F.get("features", F.lit(0)).cast("double").alias("first_value"),
    )


@query(
    "a1_block_flatten",
    needs="tiles",
    d="first_value",
    sql="SELECT slide_key, tile_index, coord_x, coord_y, CAST(features[1] AS DOUBLE) AS first_value FROM tiles",
)
def a1_blocks(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("tile_index", "features", "coord_x", "coord_y")))
    blocks = fx.tiles(spark, sf).groupBy("slide_key").agg(rows.alias("r"))
    blocks = blocks.select(
        "slide_key",
        F.transform("r", lambda t: t["features"]).alias("features"),
        F.transform("r", lambda t: F.array(t["coord_x"], t["coord_y"])).alias("coords"),
    )
    flat = readers.flatten_blocks(blocks)
    return flat.select(
        "slide_key", "tile_index", "coord_x", "coord_y", F.get("features", F.lit(0)).cast("double").alias("first_value")
    )


@query(
    "a2_tile_lookup",
    needs="tiles acts",
    sql="""SELECT slide_key, tile_index, coord_x, coord_y, label FROM tiles t
WHERE EXISTS (SELECT 1 FROM acts a WHERE a.slide_key = t.slide_key AND a.latent_idx % 20 = t.tile_index)""",
)
def a2(spark, sf):
    keys = fx.acts(spark, sf).select("slide_key", F.expr("latent_idx % 20").alias("tile_index"))
    return readers.lookup_tiles(fx.tiles(spark, sf), keys).select("slide_key", "tile_index", "coord_x", "coord_y", "label")


@query(
    "a2_tile_slice",
    needs="tiles",
    sql="SELECT slide_key, tile_index, label FROM tiles WHERE tile_index BETWEEN 4 AND 10",
)
def a2_slice(spark, sf):
    return readers.slice_tiles(fx.tiles(spark, sf), 4, 7).select("slide_key", "tile_index", "label")


@query(
    "a3_slide_shapes",
    needs="tiles",
    sql="SELECT slide_key, count(*) AS n_tiles, max(len(features)) AS feature_dim FROM tiles GROUP BY 1",
)
def a3(spark, sf):
    return registry.slide_shapes(fx.tiles(spark, sf))


def _manifest(spark, sf, structured: bool):
    paths = fx.slides(spark, sf).groupBy("split").agg(F.collect_list("feature_path").alias("p"))
    table = F.map_from_entries(F.collect_list(F.struct("split", "p"))).alias("splits")
    doc = paths.agg(table)
    if structured:
        return doc.select(F.to_json(F.struct(F.struct(F.lit(1).alias("version")).alias("meta"), "splits")).alias("value"))
    return doc.select(F.to_json("splits").alias("value"))


_SPLIT_SQL = "SELECT split, feature_path AS path, upper(slide_key) AS slide_key FROM slides"


@query("a4_splits_flat", needs="slides", sql=_SPLIT_SQL)
def a4_flat(spark, sf):
    path = scratch_path(spark, "manifest")
    _manifest(spark, sf, False).write.text(path)
    return readers.read_splits(spark, path, required=("train", "test"))


@query("a4_splits_structured", needs="slides", sql=_SPLIT_SQL)
def a4_structured(spark, sf):
    path = scratch_path(spark, "manifest")
    _manifest(spark, sf, True).write.text(path)
    return readers.read_splits(spark, path, required=("train", "test"))


@query(
    "a5_slide_index",
    needs="slides",
    sql="SELECT slide_key AS slide, cohort AS project, feature_path AS path FROM slides WHERE cohort <> ''",
)
def a5(spark, sf):
    path = scratch_path(spark, "slide-index")
    entry = F.struct(F.col("cohort").alias("dataset"), F.col("feature_path").alias("h5_path"))
    fx.slides(spark, sf).select(F.to_json(F.create_map("slide_key", entry)).alias("value")).write.text(path)
    return readers.read_slide_index(spark, path)


@query("a6_slide_list", needs="doc_names", sql="SELECT path FROM doc_names")
def a6(spark, sf):
    path = scratch_path(spark, "slide-list")
    lines = fx.doc_names(spark, sf).select(F.explode(F.array(F.concat(F.lit("  "), "path"), F.lit(" "))).alias("value"))
    lines.write.text(path)
    return readers.read_slide_list(spark, path)


_SLIDE_LIST_COLUMNS = ["slide_id", "slide_filename", "case_id", "dataset", "cohort", "wsi_path"]


@query(
    "a7_csv_scan",
    needs="full_slide_list",
    sql="SELECT slide_id, slide_filename, case_id, dataset, cohort, wsi_path, '' AS note FROM full_slide_list",
)
def a7(spark, sf):
    path = scratch_path(spark, "csv")
    fx.full_slide_list(spark, sf).select(*_SLIDE_LIST_COLUMNS).write.option("header", True).csv(path)
    return readers.read_csv_table(spark, path, [*_SLIDE_LIST_COLUMNS, "note"])


@query(
    "a8_csv_sink",
    needs="full_slide_list",
    sql="SELECT wsi_path, slide_id, '' AS wsi_ext, cohort FROM full_slide_list",
)
def a8(spark, sf):
    path, columns = scratch_path(spark, "csv"), ["wsi_path", "slide_id", "wsi_ext", "cohort"]
    writers.write_csv(fx.full_slide_list(spark, sf), path, columns)
    return readers.read_csv_table(spark, path, columns)


@query(
    "a9_json_sink",
    needs="full_slide_list",
    sql="SELECT count(*) AS slides, count(DISTINCT slide_id) AS ids, max(slide_id) AS last_id FROM full_slide_list",
)
def a9(spark, sf):
    path = scratch_path(spark, "doc")
    summary = fx.full_slide_list(spark, sf).agg(
        F.count("*").alias("slides"), F.count_distinct("slide_id").alias("ids"), F.max("slide_id").alias("last_id")
    )
    writers.write_json_doc(summary, path)
    return spark.read.schema("slides bigint, ids bigint, last_id string").json(path)


@query(
    "a10_array_sink",
    needs="model_dims",
    d="w",
    sql="SELECT latent_idx, dim, w FROM model_dims",
)
def a10(spark, sf):
    path = scratch_path(spark, "arrays")
    writers.write_arrays(fx.encoder(spark, sf).select("latent_idx", "w"), path)
    back = spark.read.parquet(path)
    return back.select("latent_idx", F.posexplode("w").alias("dim", "w"))


@query(
    "a11_stats_roundtrip",
    needs="sparse_stats",
    d="z_max z_sum variance sparsity",
    sql="""SELECT latent_idx, n_tiles, z_max, z_sum, nnz, variance, sparsity, '{"kind": "dense", "n": 64}' AS config
FROM sparse_stats""",
)
def a11(spark, sf):
    path = scratch_path(spark, "stats")
    writers.save_stats(fx.sparse_stats(spark, sf), path, {"n": fx.SPARSE_LATENTS, "kind": "dense"})
    columns = ["latent_idx", "n_tiles", "z_max", "z_sum", "nnz", "variance", "sparsity", "config"]
    return readers.load_stats(spark, path).select(*columns)


_TOP5 = """SELECT latent_idx, CAST(source_rank AS BIGINT) AS source_rank, slide_key, tile_index, coord_x, coord_y, z FROM (
  SELECT *, row_number() OVER (PARTITION BY latent_idx ORDER BY z DESC, slide_key, tile_index) AS source_rank FROM acts)
WHERE source_rank <= 5"""
_TOP_COLUMNS = ["latent_idx", "source_rank", "slide_key", "tile_index", "coord_x", "coord_y", "z"]


@query("a12_top_tiles_roundtrip", needs="acts", d="z", sql=_TOP5)
def a12(spark, sf):
    path = scratch_path(spark, "top")
    top = mining.top_tiles(fx.acts(spark, sf), None, 5)
    writers.save_top_tiles(top.limit(0), path, "20240101-000000")
    writers.save_top_tiles(top, path, "20240102-000000")
    return readers.load_top_tiles(spark, path).select(*_TOP_COLUMNS)


@query("a12_top_tiles_json", needs="acts", d="z", sql=_TOP5)
def a12_json(spark, sf):
    docs = writers.top_tiles_document(mining.top_tiles(fx.acts(spark, sf), None, 5))
    return readers.top_tiles_from_json(docs).select(*_TOP_COLUMNS)


@query(
    "a14_feature_index",
    needs="tiles",
    sql="""SELECT encoder, cohort, slide_key, count(*) AS num_tiles, max(len(features)) AS feature_dim
FROM tiles GROUP BY ALL""",
)
def a14(spark, sf):
    return registry.feature_index(fx.tiles(spark, sf))


# representative rows carry their file position, since the last one names the group
_REPS_VIEW = """reps AS (
  SELECT latent_strategy, latent_idx, ord, CASE WHEN ord % 4 = 0 THEN '' ELSE 'parent_' || (ord % 3) END AS latent_group
  FROM (SELECT CASE toxic WHEN 1 THEN 'top_variance' WHEN 0 THEN 'top_activation' ELSE ' ' END AS latent_strategy,
    doc_id % 64 AS latent_idx, doc_id AS ord FROM doc_names))"""


@query(
    "a15_bundle_reader",
    needs="selected doc_names",
    sql=f"""WITH {_REPS_VIEW},
named AS (SELECT * FROM reps WHERE trim(latent_strategy) <> ''),
sel AS (SELECT latent_strategy, latent_idx FROM selected UNION SELECT latent_strategy, latent_idx FROM named),
grp AS (SELECT latent_strategy, latent_idx, arg_max(CASE WHEN latent_group = '' THEN 'selected' ELSE latent_group END, ord) AS g
  FROM named GROUP BY 1, 2)
SELECT sel.latent_strategy, sel.latent_idx, coalesce(g, 'selected') AS latent_group FROM sel LEFT JOIN grp USING (latent_strategy, latent_idx)""",
)
def a15(spark, sf):
    reps = fx.doc_names(spark, sf).selectExpr(
        "case toxic when 1 then 'top_variance' when 0 then 'top_activation' else ' ' end as latent_strategy",
        "doc_id % 64 as latent_idx", "doc_id as ord",
        "if(doc_id % 4 = 0, '', concat('parent_', doc_id % 3)) as latent_group",
    )
    selected, groups = readers.bundle_selection(fx.selected(spark, sf), reps)
    return selected.join(groups, ["latent_strategy", "latent_idx"], "left").fillna("selected", ["latent_group"])


# --- filters -----------------------------------------------------------------------------


@query(
    "c1_require_features",
    needs="slides dense_counts",
    sql="SELECT slide_key, case_id FROM slides WHERE slide_key IN (SELECT slide_key FROM dense_counts)",
)
def c1(spark, sf):
    out = filters.require_features(fx.slides(spark, sf), fx.tiles(spark, sf))
    return out.select("slide_key", "case_id")


@query(
    "c2_drop_empty",
    needs="grid_tiles dense_slides",
    sql="""WITH g AS (SELECT slide_key, max(CASE WHEN sn % 9 IN (4, 7) THEN 1 ELSE 0 END) AS bad FROM grid_tiles GROUP BY 1)
SELECT slide_key, case_id FROM dense_slides WHERE slide_key IN (SELECT slide_key FROM g WHERE bad = 0)""",
)
def c2(spark, sf):
    counts = pooling.usable_counts(fx.grid_tiles(spark, sf), "10x_pool2x2")
    return filters.drop_empty(fx.dense_slides(spark, sf), counts).select("slide_key", "case_id")


@query("c3_positive_only", needs="pre", d="z", sql="SELECT slide_key, tile_index, latent_idx, a AS z FROM pre WHERE a > 0")
def c3(spark, sf):
    from latentlake.operators.encode import pre_activations

    pre = pre_activations(fx.tiles(spark, sf), fx.model(spark, sf))
    return filters.positive_only(pre).select("slide_key", "tile_index", "latent_idx", "z")


@query(
    "c4_keep_latents",
    needs="acts selected",
    d="z",
    sql="SELECT slide_key, tile_index, latent_idx, z FROM acts WHERE latent_idx IN (SELECT latent_idx FROM selected)",
)
def c4(spark, sf):
    out = filters.keep_latents(fx.acts(spark, sf), fx.selected(spark, sf))
    return out.select("slide_key", "tile_index", "latent_idx", "z")


@query("c5_debug_limit", needs="full_slide_list", sql="SELECT slide_id, ord FROM full_slide_list ORDER BY ord LIMIT 25")
def c5(spark, sf):
    return filters.head(fx.full_slide_list(spark, sf), 25, "ord").select("slide_id", "ord")


@query("c6_first_n", needs="acts", d="z", sql=_TOP5.replace("<= 5", "<= 3"))
def c6(spark, sf):
    return filters.first_n(mining.top_tiles(fx.acts(spark, sf), None, 5), 3).select(*_TOP_COLUMNS)


@query(
    "c7_binary_label",
    needs="doc_names",
    sql="SELECT doc_id, CASE quality WHEN 1 THEN 1 WHEN 0 THEN 0 ELSE -1 END AS y FROM doc_names",
)
def c7(spark, sf):
    text = F.expr("case quality when 1 then ' hpv+ ' when 0 then 'HPV-' else 'unknown' end")
    return fx.doc_names(spark, sf).select("doc_id", F.coalesce(filters.binary_label(text), F.lit(-1)).alias("y"))


@query(
    "c9_reject_rules",
    needs="doc_names",
    sql="""SELECT doc_id, reason FROM (SELECT doc_id, CASE WHEN quality < 0 THEN 'no_label' WHEN NOT (path LIKE '%.h5') THEN 'bad_suffix'
  WHEN toxic = 1 THEN 'toxic' END AS reason FROM doc_names) WHERE reason IS NOT NULL""",
)
def c9(spark, sf):
    rules = [
        ("no_label", F.col("quality") < 0),
        ("bad_suffix", ~F.col("path").endswith(".h5")),
        ("toxic", F.col("toxic") == 1),
    ]
    return filters.rejects(fx.doc_names(spark, sf), rules)[1].select("doc_id", "reason")


