"""Joining exported rows back to the lake: feature paths, slide paths, moved files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.functions import ids
from latentlake.runtime import attach_small, left_known, settle

#: Paths that one task joins to what was found for them, stems of paths that one task joins to listed names, and names that one task expands.
PATHS_A_TASK, STEMS_A_TASK, NAMES_A_TASK = 50_000, 100_000, 25_000

_ENCODER_COLUMN = {"uni2": "uni_path", "seal": "seal_path", "gigapath": "gigapath_path", "virchow2": "virchow2_path"}


def resolve_features(rows: DataFrame, mapping: DataFrame, features: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Add ``local_feature_path``: relative path, mapping column, then features registry.

    ``listing(path)`` is the table of files that exist. ``rows`` has feature_relpath,
    slide_key and encoder.
    """
    exists = listing.select(F.col("path").alias("_hit")).distinct()
    keyed = rows.withColumn("_rel", F.concat(F.lit(root.rstrip("/") + "/"), F.trim("feature_relpath")))
    keyed = keyed.withColumn("_rel", F.when(F.trim("feature_relpath") != "", F.col("_rel")))
    keyed = keyed.withColumn("_slide", ids.slide_id("slide_key")).withColumn("_enc", F.lower(F.trim("encoder")))

    columns = [c for c in _ENCODER_COLUMN.values() if c in mapping.columns]
    by_encoder = {v: k for k, v in _ENCODER_COLUMN.items()}
    mapped = (
        mapping.select("slide_id", *columns)
        .unpivot("slide_id", columns, "_column", "_mapped")
        .select(
            F.col("slide_id").alias("_slide"),
            F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, by_encoder[c])]), F.col("_column")).alias(
                "_enc"
            ),
            "_mapped",
        )
        .where("_mapped <> ''")
    )
    # the first features row of a (slide, encoder) decides, as a registry lookup would
    listed = features.groupBy(F.col("slide_id").alias("_slide"), F.col("encoder").alias("_enc")).agg(
        F.min_by("feature_path", "ord").alias("_listed")
    )
    found = lambda df, col: left_known(df, exists.select(F.col("_hit").alias(col), F.lit(True).alias(f"{col}_ok")), [col])
    out = left_known(left_known(keyed, mapped, ["_slide", "_enc"]), listed, ["_slide", "_enc"])
    for col in ("_rel", "_mapped", "_listed"):
        out = found(out, col)
    path = F.coalesce(*[F.when(F.col(f"{c}_ok"), F.col(c)) for c in ("_rel", "_mapped", "_listed")], F.lit(""))
    source = (
        F.when(F.col("_rel_ok"), "relpath")
        .when(F.col("_mapped_ok"), "mapping")
        .when(F.col("_listed_ok"), "features")
        .otherwise("")
    )
    return out.select(*rows.columns, path.alias("local_feature_path"), source.alias("feature_source"))


def resolve_slides(rows: DataFrame, mapping: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Add ``local_slide_path``: mapped path, cohort + file name, then any ``<slide>.*``."""
    base = F.concat(
        F.lit(root.rstrip("/") + "/wsi_slides/"), ids.norm_project("dataset"), F.lit("/"),
        ids.norm_cohort("cohort"), F.lit("/slides"),
    )
    has_cohort = ids.norm_cohort("cohort") != ""
    dims = mapping.select(
        F.col("slide_id").alias("_slide"),
        F.nullif("wsi_path", F.lit("")).alias("_mapped"),
        F.when(has_cohort, base).alias("_dir"),
        F.when(has_cohort & (F.col("slide_filename") != ""), F.concat(base, F.lit("/"), "slide_filename")).alias("_named"),
    )
    exists = listing.select("path").distinct()
    prefixed = (
        exists.select(
            ids.path_parent("path").alias("_dir"),
            F.substring_index(ids.path_name("path"), ".", 1).alias("_slide"),
            "path",
        )
        .groupBy("_dir", "_slide")
        .agg(F.min("path").alias("_globbed"))
    )
    found = lambda df, col: left_known(df, exists.select(F.col("path").alias(col), F.lit(True).alias(f"{col}_ok")), [col])
    out = left_known(rows.withColumn("_slide", ids.slide_id("slide_key")), dims, ["_slide"])
    out = left_known(found(found(out, "_mapped"), "_named"), prefixed, ["_dir", "_slide"])
    path = F.coalesce(
        F.when(F.col("_mapped_ok"), F.col("_mapped")),
        F.when(F.col("_named_ok"), F.col("_named")),
        F.col("_globbed"),
        F.lit(""),
    )
    return out.select(*rows.columns, path.alias("local_slide_path"))


def path_candidates(paths: DataFrame, roots: list[str], legacy_bases: list[str], preferred: str = "") -> DataFrame:
    """Every place a feature file may live now (J11): ``(path, place, turn, candidate)``.

    ``place`` orders the folders, ``turn`` the names inside one. A path that names
    no cohort stands for any cohort folder, written ``*``.
    """
    project = F.get(F.filter(F.split("path", "/"), lambda p: p.startswith("TCGA-")), F.lit(0))
    moved = F.array_contains(F.split("path", "/"), "extracted_features")
    facts = paths.select(
        "path",
        F.coalesce(ids.cohort_from_path("path"), F.lit("*")).alias("cohort"),
        F.when(moved, project).alias("project"),
        ids.candidate_encoders("path", preferred).alias("encoders"),
        ids.candidate_names("path").alias("names"),
    )
    named = facts.select("*", F.posexplode("names").alias("turn", "name"))
    depth = F.lit(len(ids.ENCODERS))
    lake = named.select("*", F.posexplode(F.array(*[F.lit(r.rstrip("/")) for r in roots])).alias("r", "root"))
    lake = lake.select("*", F.posexplode("encoders").alias("e", "encoder"))
    folder = F.concat("root", F.lit("/wsi_features/"), "encoder", F.lit(f"/{ids.DEFAULT_PROJECT}/"), "cohort", F.lit("/h5/"))
    parts = [
        paths.select("path", F.lit(0).alias("place"), F.lit(0).alias("turn"), F.col("path").alias("candidate")),
        lake.select("path", (1 + F.col("r") * depth + F.col("e")).alias("place"), "turn", F.concat(folder, "name").alias("candidate")),
    ]
    if legacy_bases:
        # Sub-folders of the older layout, in search order.
        legacy_dirs = ["features_uni2/", "features/", ""]
        places = F.array(*[F.lit(f"{b.rstrip('/')}/\t{d}") for b in legacy_bases for d in legacy_dirs])
        old = named.where("project is not null").select("*", F.posexplode(places).alias("b", "base"))
        spot = F.concat(F.substring_index("base", "\t", 1), "project", F.lit("/"), F.substring_index("base", "\t", -1), "name")
        after = 1 + len(roots) * len(ids.ENCODERS)
        parts.append(old.select("path", (F.lit(after) + F.col("b")).alias("place"), "turn", spot.alias("candidate")))
    return reduce(DataFrame.unionByName, parts)


def remap_paths(
    paths: DataFrame, listing: DataFrame, roots: list[str], legacy_bases: tuple[str, ...] = (), preferred: str = ""
) -> DataFrame:
    """Current location of each path: first existing candidate, else first file named ``<stem>*``.

    The prefix search is an equi-join: every listed name is expanded to its
    prefixes of the stem lengths in use (file names bound both), so no pair of
    rows is compared that does not share folder and prefix.
    """
    wanted = settle(paths.select("path").distinct())
    # short rows: sized by bytes, a task would hold millions of them in every sort of the last joins
    least = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-wanted.count() // PATHS_A_TASK))
    dealt = lambda rows: rows.repartition(parts, "path")
    files = listing.select(F.col("path").alias("candidate")).distinct()
    candidates = path_candidates(wanted, roots, list(legacy_bases), preferred)
    direct = (
        dealt(candidates.where(~F.col("candidate").contains("/*/")).join(files, "candidate"))
        .groupBy("path")
        .agg(F.min_by("candidate", F.struct("place", "turn")).alias("exact"))
    )
    direct = settle(direct)

    lost = settle(dealt(wanted).join(dealt(direct.select("path")), "path", "left_anti"))
    stems = path_candidates(lost, roots, list(legacy_bases), preferred).where("place > 0").select(
        "path", "place", "turn", ids.path_parent("candidate").alias("dir"), ids.path_stem("candidate").alias("stem")
    )
    stems = settle(stems)
    lengths = stems.agg(F.collect_set(F.length("stem")).alias("l")).scalar()
    folder = ids.path_parent("candidate")
    any_cohort = F.regexp_replace(folder, f"/{ids.DEFAULT_PROJECT}/[^/]+/h5$", f"/{ids.DEFAULT_PROJECT}/*/h5")
    named = files.where(ids.path_suffix("candidate") == ".h5").select(
        "candidate",
        ids.path_stem("candidate").alias("name"),
        folder.alias("folder"),
        F.explode(F.array_distinct(F.array(folder, any_cohort))).alias("dir"),
    )
    # only folders that are searched have their names expanded
    named = settle(named.join(attach_small(settle(stems.select("dir").distinct())), "dir", "left_semi"))
    named = named.repartition(max(least, -(-named.count() // NAMES_A_TASK)), "candidate")
    prefixes = named.select("*", F.explode(lengths).alias("n")).where(F.length("name") >= F.col("n"))
    prefixes = prefixes.groupBy("dir", "folder", F.substring("name", F.lit(1), F.col("n")).alias("stem")).agg(
        F.min(F.struct((F.length("name") > F.col("n")).alias("longer"), F.col("candidate"))).alias("best")
    )
    cells = max(least, -(-stems.count() // STEMS_A_TASK))
    met = stems.repartition(cells, "dir", "stem").join(prefixes.repartition(cells, "dir", "stem"), ["dir", "stem"])
    globbed = dealt(met).groupBy("path").agg(
        F.min_by("best.candidate", F.struct("place", "folder", "turn", "best")).alias("by_prefix")
    )
    out = dealt(wanted).join(dealt(direct), "path", "left").join(globbed, "path", "left")
    how = F.when(F.col("exact") == F.col("path"), "exact").when(F.col("exact").isNotNull(), "candidate")
    how = how.when(F.col("by_prefix").isNotNull(), "prefix").otherwise("unresolved")
    # an unresolved path is handed back unchanged
    return out.select("path", F.coalesce("exact", "by_prefix", "path").alias("resolved"), how.alias("how"))
