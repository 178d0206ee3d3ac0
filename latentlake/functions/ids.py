"""Identifier and path scalars as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Barcode patterns, encoder names and their aliases.
SLIDE_BARCODE = r"TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-\d{2}[A-Z]-\d{2}-"
DX_ANY = rf"(?i)({SLIDE_BARCODE}DX[0-9A-Z]+)"
DX_NUMBER = rf"(?i)({SLIDE_BARCODE}DX\d+)"
DX_DIGIT = rf"(?i)({SLIDE_BARCODE}DX\d)"
CASE_BARCODE = r"(?i)(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})"
PROJECT_PART = r"^TCGA-[A-Z0-9]+$"
DEFAULT_PROJECT = "TCGA"
ENCODERS = ("uni2", "seal", "gigapath", "virchow2")
ENCODER_ALIASES = {
    "uni2": "uni2",
    "uni2h": "uni2",
    "features_uni2": "uni2",
    "seal": "seal",
    "features_seal": "seal",
    "gigapath": "gigapath",
    "features_gigapath": "gigapath",
    "virchow2": "virchow2",
    "features_virchow2": "virchow2",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def path_name(path: Column | str) -> Column:
    return F.regexp_extract(F.rtrim(_col(path), F.lit("/")), r"([^/]*)$", 1)


def path_stem(path: Column | str) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(path_name(path), r"^(.+)\.[^.]+$", "$1")


def path_suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path_name(path), r"^.+(\.[^.]+)$", 1))


def path_parent(path: Column | str) -> Column:
    return F.regexp_extract(F.rtrim(_col(path), F.lit("/")), r"^(.*)/[^/]*$", 1)


def slide_id(text: Column | str, pattern: str = DX_ANY) -> Column:
    """First slide barcode, else the file stem up to its first dot; upper case."""
    barcode = _blank_to_null(F.regexp_extract(_col(text), pattern, 1))
    head = F.substring_index(path_stem(text), ".", 1)
    return F.upper(F.coalesce(barcode, head))


def case_id(slide: Column | str) -> Column:
    barcode = _blank_to_null(F.regexp_extract(_col(slide), CASE_BARCODE, 1))
    return F.upper(F.coalesce(barcode, _col(slide)))


def norm_project(project: Column | str) -> Column:
    value = F.upper(F.trim(F.coalesce(_col(project), F.lit(""))))
    return F.coalesce(_blank_to_null(value), F.lit(DEFAULT_PROJECT))


def norm_cohort(cohort: Column | str) -> Column:
    value = F.upper(F.trim(F.coalesce(_col(cohort), F.lit(""))))
    return F.regexp_replace(value, "^TCGA-", "")


def cohort_dir(project: Column | str, cohort: Column | str) -> Column:
    return F.concat(norm_project(project), F.lit("-"), norm_cohort(cohort))


def cohort_from_path(path: Column | str) -> Column:
    """First path part that starts with the project prefix, prefix removed; null when none."""
    parts = F.filter(
        F.split(F.upper(_col(path)), "/"),
        lambda part: part.startswith("TCGA-") & (F.length(part) > 5),
    )
    return F.when(F.size(parts) > 0, norm_cohort(F.get(parts, F.lit(0))))


def canonical_encoder(name: Column | str, strict: bool = True) -> Column:
    """Alias to encoder name; unknown names raise, or give null when ``strict`` is off."""
    key = F.lower(F.trim(F.coalesce(_col(name), F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in ENCODER_ALIASES.items() for x in pair])
    found = F.try_element_at(table, key)
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unsupported encoder: "), key)))


def project_key(path: Column | str) -> Column:
    parts = F.filter(F.split(F.upper(_col(path)), "/"), lambda part: part.rlike(PROJECT_PART))
    fallback = F.when(F.upper(path_stem(path)).startswith("TCGA-"), F.lit("TCGA")).otherwise(F.lit("UNKNOWN"))
    return F.coalesce(F.get(parts, F.lit(0)), fallback)


def name_ids(name: Column | str) -> Column:
    """struct(case_id, slide_barcode, raw, core) of a file name; barcodes are null when absent."""
    stem = path_stem(name)
    core = F.upper(F.substring_index(F.substring_index(stem, "_", 1), ".", 1))
    return F.struct(
        F.upper(_blank_to_null(F.regexp_extract(core, CASE_BARCODE, 1))).alias("case_id"),
        F.upper(_blank_to_null(F.regexp_extract(core, DX_DIGIT, 1))).alias("slide_barcode"),
        F.upper(stem).alias("raw"),
        core.alias("core"),
    )


def candidate_names(path: Column | str) -> Column:
    """File names under which the same slide may be stored, best first."""
    name, stem = path_name(path), path_stem(path)
    barcode = _blank_to_null(
        F.regexp_extract(stem, r"^(TCGA-[A-Za-z0-9]{2}-[A-Za-z0-9]{4}-\d{2}[A-Z]-\d{2}-DX[0-9A-Z]+)", 1)
    )
    letter = _blank_to_null(F.regexp_extract(barcode, r"-DX([A-Z])$", 1))
    numbered = F.concat(
        F.regexp_extract(barcode, r"^(.*-DX)[A-Z]$", 1),
        (F.ascii(letter) - F.ascii(F.lit("A")) + 1).cast("string"),
        F.lit(".h5"),
    )
    head = F.when(F.instr(stem, ".") > 0, F.concat(F.substring_index(stem, ".", 1), F.lit(".h5")))
    names = F.array(name, F.concat(barcode, F.lit(".h5")), F.when(letter.isNotNull(), numbered), head)
    return F.when(path_suffix(path) == ".h5", F.array_distinct(F.array_compact(names))).otherwise(F.array(name))


def candidate_encoders(path: Column | str, preferred: str = "") -> Column:
    """Preferred encoder, then those the path mentions, then the rest; distinct, in order."""
    text = F.lower(_col(path))
    first = [F.lit(preferred)] if preferred in ENCODERS else []
    seal = F.when(text.contains("features_seal") | text.contains("/seal/"), F.lit("seal"))
    named = [F.when(text.contains(e), F.lit(e)) for e in ("uni2", "gigapath", "virchow2")]
    rest = [F.lit(e) for e in ENCODERS]
    return F.array_distinct(F.array_compact(F.array(*first, seal, *named, *rest)))


def feature_relpath(path: Column | str, root: str) -> Column:
    """Path below ``root``, else from ``wsi_features/`` on, else the bare file name."""
    prefix = root.rstrip("/") + "/"
    below = F.when(_col(path).startswith(prefix), F.substr(_col(path), F.lit(len(prefix) + 1)))
    tail = _blank_to_null(F.regexp_extract(_col(path), r"^(?:.*?/)?(wsi_features/.*)$", 1))
    return F.coalesce(below, tail, path_name(path))


def stable_hash32(text: Column | str) -> Column:
    """First eight hex digits of md5 as a non-negative integer."""
    return F.conv(F.substring(F.md5(_col(text)), 1, 8), 16, 10).cast("bigint")


def latent_group(df: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Add ``latent_group``: ``parent_<k>`` where a parent is known, else ``selected``."""
    if parents is None:
        return df.withColumn("latent_group", F.lit("selected"))
    lookup = parents.select("latent_idx", F.col("parent").cast("bigint").alias("_parent"))
    label = F.coalesce(F.concat(F.lit("parent_"), F.col("_parent")), F.lit("selected"))
    return df.join(lookup, "latent_idx", "left").withColumn("latent_group", label).drop("_parent")
