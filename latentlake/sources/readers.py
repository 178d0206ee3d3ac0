"""Scans: Parquet tables with fixed schemas, JSON documents, lists and all-string CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake import schemas
from latentlake.functions import ids
from latentlake.runtime import attach_small


def read_tiles(spark: SparkSession, path: str, encoder: str | None = None, split: str | None = None) -> DataFrame:
    """Tile table; partition filters on encoder / split, absent coordinates become 0 (A1)."""
    return normalize_tiles(spark.read.schema(schemas.TILES).parquet(path), encoder, split)


def normalize_tiles(tiles: DataFrame, encoder: str | None = None, split: str | None = None) -> DataFrame:
    if encoder is not None:
        tiles = tiles.where(F.col("encoder") == encoder)
    if split is not None:
        tiles = tiles.where(F.col("split") == split)
    return tiles.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("coord_x", "coord_y")})


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """Tile rows from per-slide matrices ``features`` array<array<..>>, ``coords`` optional (A1).

    A leading singleton axis has to be removed by the caller (``features[0]``).
    """
    rows = blocks.select("*", F.posexplode("features").alias("tile_index", "vec"))
    if "coords" in blocks.columns:
        xy = F.get("coords", F.col("tile_index"))
        rows = rows.withColumns({"coord_x": F.coalesce(F.get(xy, F.lit(0)), F.lit(0)).cast("int"),
                                 "coord_y": F.coalesce(F.get(xy, F.lit(1)), F.lit(0)).cast("int")})
    else:
        rows = rows.withColumns({"coord_x": F.lit(0), "coord_y": F.lit(0)})
    return rows.drop("features", "coords").withColumnRenamed("vec", "features")


def lookup_tiles(tiles: DataFrame, keys: DataFrame) -> DataFrame:
    """Only the named (slide_key, tile_index) rows (A2)."""
    named = keys.select("slide_key", "tile_index").distinct()
    return tiles.join(attach_small(named), ["slide_key", "tile_index"], "left_semi")


def slice_tiles(tiles: DataFrame, start: int, length: int) -> DataFrame:
    """Rows ``start .. start+length-1`` of every slide (A2)."""
    return tiles.where(F.col("tile_index").between(start, start + length - 1))


_PATHS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def parse_splits(docs: DataFrame, col: str = "value", required: tuple[str, ...] = ()) -> DataFrame:
    """``(split, path, slide_key)`` from manifest JSON text, flat or under ``splits`` (A4)."""
    nested = F.from_json(F.get_json_object(col, "$.splits"), _PATHS)
    flat = F.from_json(col, T.MapType(T.StringType(), T.StringType()))
    listed = F.map_filter(flat, lambda k, v: v.startswith("["))
    table = F.coalesce(nested, F.transform_values(listed, lambda k, v: F.from_json(v, T.ArrayType(T.StringType()))))
    rows = docs.select(F.explode(table).alias("split", "paths")).select("split", F.explode("paths").alias("path"))
    rows = rows.withColumn("slide_key", ids.slide_id("path"))
    if required:
        present = {r["split"] for r in rows.where(F.col("split").isin(*required)).select("split").distinct().collect()}
        missing = set(required) - present
        if missing:
            raise KeyError(f"manifest lacks splits: {sorted(missing)}")
    return rows


def read_splits(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    return parse_splits(spark.read.text(path, wholetext=True), required=required)


_INDEX = T.MapType(
    T.StringType(),
    T.StructType([T.StructField("dataset", T.StringType()), T.StructField("h5_path", T.StringType())]),
)


def parse_slide_index(docs: DataFrame, col: str = "value") -> DataFrame:
    """``(slide, project, path)`` from slide-index JSON; entries without either field are dropped (A5)."""
    rows = docs.select(F.explode(F.from_json(col, _INDEX)).alias("slide", "entry"))
    out = rows.select("slide", F.col("entry.dataset").alias("project"), F.col("entry.h5_path").alias("path"))
    return out.where("coalesce(project, '') <> '' and coalesce(path, '') <> ''")


def read_slide_index(spark: SparkSession, path: str) -> DataFrame:
    """Slide index; one JSON map per line, so that large indexes split."""
    return parse_slide_index(spark.read.text(path))


def read_slide_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines of a list file."""
    lines = spark.read.text(path).select(F.trim("value").alias("path"))
    return lines.where("path <> ''")


def read_file_listing(spark: SparkSession, folder: str, pattern: str = "*.h5") -> DataFrame:
    """Files below a folder matching a name pattern, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(folder).select("path")


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | list[str]) -> DataFrame:
    """All-string CSV with a header; an absent file is an empty table."""
    if not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in schema])
    try:
        # columns follow the header by name; absent ones come back empty
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return raw.select(
        *[
            (F.coalesce(F.col(f"`{f.name}`"), F.lit("")) if f.name in raw.columns else F.lit("")).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


_TOP_RECORD = "array<struct<score:double,activation:double,h5_path:string,slide_key:string,tile_idx:bigint,tile_index:bigint,x:int,y:int,coord_x:int,coord_y:int>>"


def top_tiles_from_json(docs: DataFrame, col: str = "value") -> DataFrame:
    """Flat top tiles from a nested ``{"top_tiles": {latent: [...]}}`` document."""
    table = F.from_json(F.get_json_object(col, "$.top_tiles"), f"map<string,{_TOP_RECORD}>")
    rows = docs.select(F.explode(table).alias("latent", "items")).select(
        F.col("latent").cast("bigint").alias("latent_idx"), F.posexplode("items").alias("pos", "t")
    )
    return rows.select(
        "latent_idx",
        (F.col("pos") + 1).alias("source_rank"),
        F.coalesce("t.slide_key", ids.slide_id(F.coalesce("t.h5_path", F.lit("")))).alias("slide_key"),
        F.coalesce("t.h5_path", F.lit("")).alias("h5_path"),
        F.coalesce("t.tile_index", "t.tile_idx", F.lit(-1)).cast("bigint").alias("tile_index"),
        F.coalesce("t.coord_x", "t.x", F.lit(0)).alias("coord_x"),
        F.coalesce("t.coord_y", "t.y", F.lit(0)).alias("coord_y"),
        F.coalesce("t.activation", "t.score", F.lit(0.0)).alias("z"),
    )


def bundle_selection(manifest_selected: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected latents per strategy, latent groups) of a bundle.

    Manifest lists and representative rows are united; the last representative row
    of a latent names its group.
    """
    named = reps.where(F.trim("latent_strategy") != "")
    keys = ["latent_strategy", "latent_idx"]
    selected = manifest_selected.select(*keys).unionByName(named.select(*keys)).distinct()
    label = F.coalesce(F.nullif("latent_group", F.lit("")), F.lit("selected"))
    groups = named.groupBy(*keys).agg(F.max_by(label, F.col("ord")).alias("latent_group"))
    return selected, groups


def read_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected with groups, representatives, support) of an exported bundle folder."""
    reps = read_csv_table(spark, f"{folder}/representative_latents", schemas.SUPPORT_COLUMNS)
    support = read_csv_table(spark, f"{folder}/representative_support_tiles", schemas.SUPPORT_COLUMNS)
    typed = reps.withColumn("latent_idx", F.col("latent_idx").cast("bigint")).withColumn(
        "ord", F.struct(F.input_file_name(), F.monotonically_increasing_id())
    )
    detail = "map<string,struct<selected_latents:array<bigint>>>"
    docs = spark.read.text(f"{folder}/bundle_manifest")
    listed = docs.select(F.explode(F.from_json(F.get_json_object("value", "$.details_by_strategy"), detail)).alias("latent_strategy", "d"))
    listed = listed.select("latent_strategy", F.explode("d.selected_latents").alias("latent_idx"))
    selected, groups = bundle_selection(listed, typed)
    joined = selected.join(groups, ["latent_strategy", "latent_idx"], "left")
    return joined.fillna("selected", ["latent_group"]), reps, support


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/stats")


def load_top_tiles(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Top tiles of one tag, or of the latest tag."""
    table = spark.read.parquet(path)
    if tag is None:
        latest = table.agg(F.max("tag").alias("tag")).first()["tag"]
        tag = latest if latest is not None else ""
    return table.where(F.col("tag") == tag)
