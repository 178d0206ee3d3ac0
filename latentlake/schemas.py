"""Table schemas and exported column orders."""

from __future__ import annotations

from pyspark.sql import types as T

TILES = T.StructType(
    [
        T.StructField("slide_key", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("cohort", T.StringType()),
        T.StructField("encoder", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("tile_index", T.LongType()),
        T.StructField("coord_x", T.IntegerType()),
        T.StructField("coord_y", T.IntegerType()),
        T.StructField("features", T.ArrayType(T.FloatType())),
    ]
)

# Column orders of the exported tables.
MAPPING_COLUMNS = [
    "slide_id", "case_id", "dataset", "cohort", "slide_filename", "wsi_path", "uni_path", "seal_path",
]
SUPPORT_COLUMNS = [
    "run_name", "stage", "dataset", "encoder", "data_split", "latent_strategy", "latent_idx", "latent_group",
    "representative_method", "row_kind", "method_rank", "source_rank", "case_id", "slide_key", "cohort",
    "tile_index", "coord_x", "coord_y", "feature_relpath", "feature_h5_name", "legacy_h5_path", "activation",
    "method_score", "slide_support_count", "slide_max_activation", "slide_mean_activation",
    "max_activation_global", "variance_global", "sparsity_score_global",
]
LATENT_SUMMARY_COLUMNS = [
    "run_name", "stage", "dataset", "encoder", "data_split", "latent_strategy", "latent_idx", "latent_group",
    "support_tile_count", "unique_slide_count", "unique_case_count", "activation_max", "activation_mean",
    "activation_p50", "activation_p90", "max_activation_global", "variance_global", "sparsity_score_global",
]
SLIDE_STATS_COLUMNS = [
    "latent_strategy", "latent_idx", "latent_group", "case_id", "slide_key", "cohort", "slide_max_activation",
    "slide_mean_positive_activation", "positive_tile_count", "total_tiles_seen", "fires",
]
LATENT_METRIC_COLUMNS = [
    "latent_idx", "is_alive", "selected_strategies", "max_activation_global", "variance_global",
    "sparsity_score_global", "slide_prevalence", "case_prevalence", "num_tiles_positive",
    "mean_positive_activation", "max_activation_seen", "cohort_entropy", "top_cohort", "top_cohort_share",
]
FEATURE_INDEX_COLUMNS = [
    "feature_vector_row", "local_feature_path", "feature_relpath", "slide_key", "case_id", "encoder",
    "tile_index", "coord_x", "coord_y",
]
REPRESENTATIVE_METHODS = ("max_activation", "median_activation", "diverse_support", "slide_spread")
