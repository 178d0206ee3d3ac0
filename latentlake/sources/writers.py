"""Sinks: CSV with fixed columns, JSON documents, Parquet arrays, statistics and top tiles."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exported(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in export order as text; absent columns and nulls become ''."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return df.select(*[value(c).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Header CSV with a fixed column order."""
    writer = exported(df, columns).write.mode("overwrite").option("header", True).option("emptyValue", "")
    writer.option("quote", '"').option("escape", '"').csv(path)


def write_json_doc(df: DataFrame, path: str) -> None:
    """Each row as one JSON document (A9); summaries and manifests have one row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Vectors as float arrays in Parquet (A10)."""
    arrays = [f.name for f in df.schema.fields if f.dataType.simpleString() == "array<double>"]
    df.withColumns({c: F.col(c).cast("array<float>") for c in arrays}).write.mode("overwrite").parquet(path)


def save_stats(stats: DataFrame, path: str, config: dict) -> None:
    """Latent statistics with the configuration that produced them."""
    stats.withColumn("config", F.lit(json.dumps(config, sort_keys=True))).write.mode("overwrite").parquet(f"{path}/stats")


def save_top_tiles(top: DataFrame, path: str, tag: str | None = None) -> str:
    """Append top tiles under a tag, a UTC time stamp by default."""
    tag = tag or datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")
    top.withColumn("tag", F.lit(tag)).write.mode("append").partitionBy("tag").parquet(path)
    return tag


def top_tiles_document(top: DataFrame) -> DataFrame:
    """Nested JSON per latent, as exchanged with other tools; lists hold topn entries."""
    item = F.struct(
        F.col("z").alias("score"), F.col("slide_key"), F.col("tile_index").alias("tile_idx"),
        F.col("coord_x").alias("x"), F.col("coord_y").alias("y"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("source_rank", item.alias("t")))), lambda r: r["t"])
    packed = top.groupBy("latent_idx").agg(ordered.alias("items"))
    entry = F.create_map(F.col("latent_idx").cast("string"), F.col("items"))
    return packed.select(F.to_json(F.struct(entry.alias("top_tiles"))).alias("value"))


def write_feature_index(tiles: DataFrame, path: str) -> None:
    """Feature index partitioned by encoder and cohort."""
    from latentlake.operators.registry import feature_index

    feature_index(tiles).write.mode("overwrite").partitionBy("encoder", "cohort").parquet(path)
