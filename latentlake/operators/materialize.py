"""Attach vectors and slide files to exported rows; one stored vector per distinct tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake import schemas
from latentlake.functions import ids
from latentlake.operators.sampling import tile_position
from latentlake.runtime import attach_small, settle


def bundle_rows(reps: DataFrame, support: DataFrame, group: list[str], rank: str = "method_rank") -> DataFrame:
    """Representatives first, then support, with a dense zero-based ``row_pos`` (K2).

    Positions come from group sizes first, then from the rank inside a group, so
    no task sorts the whole bundle.
    """
    both = reps.withColumn("_part", F.lit(0)).unionByName(support.withColumn("_part", F.lit(1)))
    keys = ["_part", *group]
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = both.groupBy(*keys).agg(F.count("*").alias("_n"))
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys).orderBy(rank)
    placed = both.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, keys)
    return placed.withColumn("row_pos", (F.col("_off") + F.col("_in")).cast("bigint")).drop("_part", "_in", "_off")


def vector_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Dense vector ids in first-seen order of the distinct keys."""
    first = rows.groupBy(*keys).agg(F.min("row_pos").alias("first_pos")).withColumn("_all", F.lit("all"))
    return tile_position(first, key="_all", order="first_pos", name="feature_vector_row").select(
        *keys, "first_pos", "feature_vector_row"
    )


def materialize(rows: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(materialised rows, vector table).

    ``rows`` carries row_pos, local_feature_path, local_slide_path and the tile key.
    ``tiles`` is read only for the tiles named.
    """
    keys = ["local_feature_path", "slide_key", "tile_index"]
    wanted = attach_small(settle(rows.where("local_feature_path <> ''").select(*keys).distinct()))
    named = tiles.select("slide_key", "tile_index", "features")
    vectors = named.join(wanted, ["slide_key", "tile_index"])
    # the keys that have a vector, found once; vectors themselves are read where they are kept
    matched = settle(tiles.select("slide_key", "tile_index").join(wanted, ["slide_key", "tile_index"]).select(*keys, F.lit(True).alias("_has")))
    found = rows.join(matched, keys, "left")
    numbered = vector_rows(found.where("_has"), keys)
    out = found.join(numbered.drop("first_pos"), keys, "left")

    no_path, no_slide = F.col("local_feature_path") == "", F.col("local_slide_path") == ""
    parts = [
        F.when(no_path, "missing_feature"),
        F.when(no_slide, "missing_slide"),
        F.when(~no_path & F.col("_has").isNull(), "feature_error"),
    ]
    status = F.coalesce(F.nullif(F.concat_ws("+", *parts), F.lit("")), F.lit("ok"))
    final = out.select(
        *rows.columns,
        status.alias("status"),
        F.concat_ws("; ", *parts).alias("error"),
        F.coalesce("feature_vector_row", F.lit(-1)).alias("feature_vector_row"),
    )
    facts = ["feature_relpath", "case_id", "encoder", "coord_x", "coord_y"]
    first = rows.select("row_pos", *[c for c in facts if c in rows.columns])
    table = vectors.join(attach_small(settle(numbered.join(first, F.col("first_pos") == F.col("row_pos")))), keys)
    wanted_columns = [c for c in schemas.FEATURE_INDEX_COLUMNS if c in table.columns]
    return final, table.select(*wanted_columns, "features")


def materialize_summary(rows: DataFrame) -> DataFrame:
    """Counters over materialised rows."""
    has = lambda text: F.count_if(F.col("status").contains(text))
    return rows.agg(
        F.count("*").alias("rows_total"),
        F.count_if(F.col("feature_vector_row") >= 0).alias("rows_with_feature_vector"),
        has("missing_feature").alias("rows_missing_feature"),
        has("missing_slide").alias("rows_missing_slide"),
        has("feature_error").alias("rows_feature_error"),
        F.count_distinct(F.when(F.col("feature_vector_row") >= 0, F.col("feature_vector_row"))).alias(
            "unique_feature_vectors"
        ),
    )


def viewer_resolve(rows: DataFrame, resolved: DataFrame, mapping: DataFrame) -> DataFrame:
    """Viewer rows with slide path, cohort and status.

    ``resolved`` is (slide_key, local_slide_path), one row per slide.
    """
    keyed = rows.withColumn("slide_key", ids.slide_id("slide_key"))
    dims = mapping.select(F.col("slide_id").alias("slide_key"), F.col("cohort").alias("_cohort"))
    out = keyed.join(resolved.select("slide_key", "local_slide_path"), "slide_key", "left").join(dims, "slide_key", "left")
    path = F.coalesce("local_slide_path", F.lit(""))
    missing = path == ""
    return out.select(
        *rows.columns,
        path.alias("slide_path"),
        F.coalesce("_cohort", F.lit("")).alias("mapping_cohort"),
        F.when(missing, "missing_slide").otherwise("ok").alias("status"),
        F.when(missing, "slide not in registry").otherwise("").alias("error"),
    )
