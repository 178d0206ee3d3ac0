"""Slide / feature registry: loads, mapping, missing and ambiguous ids, health and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake import schemas
from latentlake.functions import ids
from latentlake.runtime import settle


def _or_default(df: DataFrame, name: str, default: Column) -> Column:
    """A column's value, or ``default`` only when the whole column is absent."""
    return (F.coalesce(F.col(name), F.lit("")) if name in df.columns else default).alias(name)


def load_slides(raw: DataFrame, project: str = ids.DEFAULT_PROJECT) -> DataFrame:
    """Slide-list rows with defaults and file suffix (J7); ``ord`` keeps the file order."""
    text = F.coalesce(F.nullif("slide_id", F.lit("")), F.col("slide_filename"), F.lit(""))
    keyed = raw.withColumn("slide_id", ids.slide_id(text))
    wsi = F.coalesce("wsi_path", F.lit(""))
    return keyed.select(
        "slide_id",
        _or_default(raw, "slide_filename", F.lit("")),
        _or_default(raw, "case_id", ids.case_id("slide_id")),
        _or_default(raw, "dataset", ids.norm_project(F.lit(project))),
        _or_default(raw, "cohort", F.lit("")),
        wsi.alias("wsi_path"),
        ids.path_suffix(wsi).alias("wsi_ext"),
        "ord",
    )


def load_features(raw: DataFrame, project: str = ids.DEFAULT_PROJECT) -> DataFrame:
    """Feature-index rows with ids and file suffix."""
    text = F.coalesce(F.nullif("slide_id", F.lit("")), F.col("path"), F.lit(""))
    return raw.withColumn("slide_id", ids.slide_id(text)).select(
        "slide_id",
        ids.case_id("slide_id").alias("case_id"),
        ids.norm_project(F.lit(project)).alias("dataset"),
        "cohort",
        "encoder",
        F.coalesce("path", F.lit("")).alias("feature_path"),
        ids.path_suffix("path").alias("feature_ext"),
        "ord",
    )


def ambiguous_slides(slides: DataFrame) -> DataFrame:
    """Ids listed more than once with their candidate paths."""
    paths = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("wsi_path") != "", F.struct("ord", "wsi_path")))),
        lambda x: x["wsi_path"],
    )
    dup = slides.groupBy("slide_id").agg(F.count("*").alias("candidate_count")).where("candidate_count > 1")
    # only copies of ambiguous ids reach the list; the report itself spells all of them out
    listed = slides.join(dup.select("slide_id"), "slide_id", "left_semi")
    joined = listed.groupBy("slide_id").agg(F.concat_ws("|", paths).alias("candidate_paths"))
    return dup.join(joined, "slide_id").select("slide_id", "candidate_count", "candidate_paths")


def encoder_paths(features: DataFrame) -> DataFrame:
    """Feature paths pivoted to one column per encoder; the last row wins."""
    last = lambda e: F.max_by(F.when(F.col("encoder") == e, F.col("feature_path")),
                              F.when(F.col("encoder") == e, F.col("ord")))
    names = {"uni2": "uni_path", "seal": "seal_path", "gigapath": "gigapath_path", "virchow2": "virchow2_path"}
    return features.groupBy("slide_id").agg(*[F.coalesce(last(e), F.lit("")).alias(names[e]) for e in ids.ENCODERS])


def registry(
    slides: DataFrame, features: DataFrame, project: str = ids.DEFAULT_PROJECT
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mapping, missing_slides, missing_features, ambiguous) over the union of ids."""
    ambiguous = ambiguous_slides(slides)
    # one aggregate row per id: copies of an id are combined before the join
    first = slides.groupBy("slide_id").agg(
        F.count("*").alias("listed"),
        *[F.first(c).alias(c) for c in ("case_id", "dataset", "cohort", "slide_filename", "wsi_path")],
    )
    paths = encoder_paths(features).withColumn("has_feature", F.lit(True))
    both = first.join(paths, "slide_id", "full_outer").where("listed is null or listed = 1")
    full = both.select(
        "slide_id",
        F.coalesce("case_id", ids.case_id("slide_id")).alias("case_id"),
        F.coalesce("dataset", ids.norm_project(F.lit(project))).alias("dataset"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("cohort", "slide_filename", "wsi_path")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("uni_path", "seal_path", "gigapath_path", "virchow2_path")],
        F.col("listed").isNotNull().alias("_slide"),
        F.col("has_feature").isNotNull().alias("_feature"),
    )
    mapping = full.drop("_slide", "_feature")
    no_slide = full.where("not _slide and _feature").select(*schemas.MAPPING_COLUMNS)
    no_feature = full.where("_slide and not _feature").select(*schemas.MAPPING_COLUMNS)
    return mapping, no_slide, no_feature, ambiguous


def registry_counts(slides: DataFrame, features: DataFrame) -> DataFrame:
    """One row of registry sizes."""
    mapping, no_slide, no_feature, ambiguous = registry(slides, features)
    size = lambda df: df.agg(F.count("*").alias("n")).scalar()
    return slides.agg(F.count("*").alias("slides")).select(
        "slides",
        size(features).alias("features"),
        size(mapping).alias("mapping_rows"),
        size(no_slide).alias("missing_slides"),
        size(no_feature).alias("missing_features"),
        size(ambiguous).alias("ambiguous_slides"),
    )


def upsert_slides(existing: DataFrame, new_ids: DataFrame, cohort: str) -> DataFrame:
    """Existing slide rows kept (last duplicate wins), new ids added with defaults."""
    text = F.coalesce(F.nullif("slide_id", F.lit("")), F.col("slide_filename"), F.lit(""))
    keyed = existing.withColumn("slide_id", ids.slide_id(text)).where("slide_id <> ''")
    fields = ["slide_filename", "case_id", "dataset", "cohort", "wsi_path"]
    packed = F.max_by(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in fields if c in existing.columns]), "ord")
    kept = keyed.groupBy("slide_id").agg(packed.alias("r"))
    fresh = new_ids.select(ids.slide_id("slide_id").alias("slide_id")).distinct()
    defaults = {
        "slide_filename": F.lit(""),
        "case_id": ids.case_id("slide_id"),
        "dataset": F.lit(ids.DEFAULT_PROJECT),
        "cohort": F.lit(cohort),
        "wsi_path": F.lit(""),
    }
    value = lambda c: F.coalesce(F.col(f"r.{c}"), defaults[c]) if c in existing.columns else defaults[c]
    return kept.join(fresh, "slide_id", "full_outer").select("slide_id", *[value(c).alias(c) for c in fields])


def slide_shapes(tiles: DataFrame) -> DataFrame:
    """``(slide_key, n_tiles, feature_dim)`` (A3)."""
    return tiles.groupBy("slide_key").agg(
        F.count("*").alias("n_tiles"), F.max(F.size("features")).alias("feature_dim")
    )


def feature_index(tiles: DataFrame) -> DataFrame:
    """Tiles and width per (encoder, cohort, slide)."""
    return tiles.groupBy("encoder", "cohort", "slide_key").agg(
        F.count("*").alias("num_tiles"), F.max(F.size("features")).alias("feature_dim")
    )


def health(tiles: DataFrame, dims: dict[str, int] | int) -> tuple[DataFrame, DataFrame]:
    """Per-slide status rows and ok / error counts per encoder.

    A slide fails on a null vector, a wrong width, a non-finite value or a tile
    index used twice; copies of an index are counted before slides are grouped.
    """
    if isinstance(dims, int):
        width: Column = F.lit(dims)
    else:
        width = F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.items() for x in kv]), F.col("encoder"))
    vec = F.col("features")
    bad_value = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checked = tiles.select(
        "encoder",
        "cohort",
        "slide_key",
        "tile_index",
        F.size(vec).alias("d"),
        vec.isNull().alias("no_vec"),
        (vec.isNotNull() & (F.size(vec) != width)).alias("bad_dim"),
        F.coalesce(bad_value, F.lit(False)).alias("bad_val"),
    )
    per_index = checked.groupBy("encoder", "cohort", "slide_key", "tile_index").agg(
        F.count("*").alias("n"),
        F.max("d").alias("d"),
        *[F.max(c).alias(c) for c in ("no_vec", "bad_dim", "bad_val")],
    )
    per_slide = per_index.groupBy("encoder", "cohort", "slide_key").agg(
        F.sum("n").alias("num_tiles"),
        F.max("d").alias("feature_dim"),
        F.max("n").alias("copies"),
        *[F.max(c).alias(c) for c in ("no_vec", "bad_dim", "bad_val")],
    )
    error = (
        F.when(F.col("no_vec"), "null_features")
        .when(F.col("bad_dim"), "bad_feature_shape")
        .when(F.col("bad_val"), "non_finite_value")
        .when(F.col("copies") > 1, "duplicate_tile_index")
        .otherwise("")
    )
    rows = settle(per_slide.select(
        "encoder",
        "cohort",
        "slide_key",
        F.when(error == "", "ok").otherwise("error").alias("status"),
        error.alias("error"),
        "num_tiles",
        "feature_dim",
    ))
    return rows, rows.groupBy("encoder").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error")
    )


def validate(
    slide_lists: DataFrame, tiles: DataFrame, dims: dict[str, int] | int, encoders=ids.ENCODERS, rows: DataFrame | None = None
) -> DataFrame:
    """Issues ``(severity, kind, subject)``: unreadable features, absent encoders, cohorts without a list (K6).

    Pass the rows of health() when they are at hand; tiles are then read for their keys alone.
    """
    rows = health(tiles, dims)[0] if rows is None else rows
    unreadable = rows.where("status = 'error'").select(
        F.lit("error").alias("severity"), F.lit("unreadable_features").alias("kind"), F.col("slide_key").alias("subject")
    )
    spark = tiles.sparkSession
    wanted = spark.createDataFrame([(e,) for e in encoders], "encoder string")
    absent = wanted.join(tiles.select("encoder").distinct(), "encoder", "left_anti").select(
        F.lit("warning").alias("severity"), F.lit("missing_encoder").alias("kind"), F.col("encoder").alias("subject")
    )
    listed = slide_lists.select(ids.norm_cohort("cohort").alias("cohort")).distinct()
    unlisted = (
        tiles.select(ids.norm_cohort("cohort").alias("cohort"))
        .distinct()
        .join(listed, "cohort", "left_anti")
        .select(
            F.lit("warning").alias("severity"),
            F.lit("missing_slide_list").alias("kind"),
            F.col("cohort").alias("subject"),
        )
    )
    return unreadable.unionByName(absent).unionByName(unlisted)


#: Folders that a lake must have.
REQUIRED_FOLDERS = ("wsi_slides", "wsi_features", "registry", "metadata/indexes", "metadata/manifests", "metadata/splits")


def validate_files(listing: DataFrame, root: str, encoders=ids.ENCODERS, project: str = ids.DEFAULT_PROJECT) -> DataFrame:
    """Issues ``(severity, kind, subject)`` of the files of a lake (K6): required folders without anything in them, encoder folders that are
    absent, cohort folders without feature files and cohort folders without an index.

    ``listing`` (path) has the files below ``root``; folders are known by their files, so an empty folder counts as missing.
    """
    root, spark = root.rstrip("/"), listing.sparkSession
    inside = listing.where(F.startswith("path", F.lit(f"{root}/"))).select(F.substring("path", len(root) + 2, 1 << 20).alias("at"))
    parts = F.split("at", "/")
    part = lambda i: F.get(parts, F.lit(i))
    held = inside.select(F.explode(F.array(*(F.when(F.startswith("at", F.lit(f"{f}/")), F.lit(f)) for f in REQUIRED_FOLDERS))).alias("folder"))
    held = held.where("folder is not null").distinct()
    issue = lambda df, severity, kind, subject: df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), subject.alias("subject"))
    wanted = spark.createDataFrame([(f,) for f in REQUIRED_FOLDERS], "folder string")
    missing = issue(wanted.join(held, "folder", "left_anti"), "error", "missing_folder", F.concat(F.lit(f"{root}/"), "folder"))
    mine = part(2) == F.upper(F.trim(F.lit(project)))
    features = inside.where((F.size(parts) >= 5) & (part(0) == "wsi_features") & mine).select(
        part(1).alias("encoder"), part(3).alias("cohort"), (part(4) == "index.csv").alias("index"), ((part(4) == "h5") & (F.size(parts) > 5)).alias("h5")
    )
    cohorts = features.where(F.col("encoder").isin(*encoders)).groupBy("encoder", "cohort").agg(F.max("index").alias("index"), F.max("h5").alias("h5"))
    folder = F.concat(F.lit(f"{root}/wsi_features/"), "encoder", F.lit(f"/{project}/"), "cohort")
    known = spark.createDataFrame([(e,) for e in encoders], "encoder string")
    absent = known.join(cohorts.select("encoder").distinct(), "encoder", "left_anti")
    return (
        missing.unionByName(issue(absent, "warning", "missing_encoder_folder", F.concat(F.lit(f"{root}/wsi_features/"), "encoder", F.lit(f"/{project}"))))
        .unionByName(issue(cohorts.where(~F.col("h5")), "error", "missing_h5_folder", F.concat(folder, F.lit("/h5"))))
        .unionByName(issue(cohorts.where(F.col("h5") & ~F.col("index")), "warning", "missing_index", F.concat(folder, F.lit("/index.csv"))))
    )


def validation_summary(issues: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: feature files read without error, errors, warnings, and whether the layout is valid (K6). ``rows`` are those of health()."""
    ok = rows.agg(F.count_if(F.col("status") == "ok").alias("n")).scalar()
    return issues.agg(
        F.coalesce(F.count_if(F.col("severity") == "error"), F.lit(0)).alias("errors"), F.coalesce(F.count_if(F.col("severity") == "warning"), F.lit(0)).alias("warnings")
    ).select(ok.alias("validated_feature_files"), "errors", "warnings", (F.col("errors") == 0).alias("valid"))


def dedupe_paths(slides: DataFrame, project: str = "project") -> DataFrame:
    """Distinct (project, path) pairs (K5)."""
    return slides.select(project, "path").distinct()
