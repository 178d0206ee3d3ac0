"""2x2 grid pooling: the 10x view of a slide built from its 20x tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake.runtime import attach_small, settle, ship

#: Width in pixels of the coordinate blocks used to find neighbours.
_BLOCK = 4096


def _axis_steps(tiles: DataFrame, axis: str) -> DataFrame:
    """Smallest positive gap between distinct coordinates of one axis, per slide.

    Integer coordinates are cut into 4096-pixel blocks, so a window holds at most
    4096 values even for a slide with a third of all tiles; gaps across blocks
    come from block minima and maxima.
    """
    v = F.col(axis).cast("bigint")
    values = tiles.select("slide_key", v.alias("v")).distinct().withColumn("blk", F.floor(F.col("v") / _BLOCK))
    inside = Window.partitionBy("slide_key", "blk").orderBy("v")
    gaps = values.withColumn("gap", F.col("v") - F.lag("v").over(inside))
    blocks = gaps.groupBy("slide_key", "blk").agg(
        F.min("gap").alias("gap"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    across = Window.partitionBy("slide_key").orderBy("blk")
    joined = blocks.withColumn("step", F.least("gap", F.col("lo") - F.lag("hi").over(across)))
    return joined.groupBy("slide_key").agg(F.min("step").alias(f"step_{axis[-1]}"), F.min("lo").alias(f"{axis[-1]}0"))


def grid_steps(tiles: DataFrame) -> DataFrame:
    """``(slide_key, step_x, step_y, x0, y0)``; a step is null on a single row or column."""
    return _axis_steps(tiles, "coord_x").join(_axis_steps(tiles, "coord_y"), "slide_key")


def _on_grid(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Tiles with their grid cell; ``off_grid`` marks coordinates between cells."""
    placed = tiles.join(grid, "slide_key")
    rel_x = F.col("coord_x").cast("bigint") - F.col("x0")
    rel_y = F.col("coord_y").cast("bigint") - F.col("y0")
    return placed.select(
        *tiles.columns,
        ((rel_x % F.col("step_x") != 0) | (rel_y % F.col("step_y") != 0)).alias("off_grid"),
        F.floor(rel_x / F.col("step_x")).alias("qx"),
        F.floor(rel_y / F.col("step_y")).alias("qy"),
    )


def slide_grid(tiles: DataFrame) -> DataFrame:
    """One row per slide: grid steps, origin and the reason it is unusable, if any.

    Reads only keys and coordinates.
    """
    xy = ("coord_x", "coord_y")
    keys = tiles.select("slide_key", *xy)
    broken = F.lit(False)
    for c in xy:
        if tiles.schema[c].dataType.typeName() in ("float", "double", "decimal"):
            broken = broken | (F.col(c) != F.round(c)) | F.isnan(c)
    fractional = keys.groupBy("slide_key").agg(F.max(broken).alias("fractional"))
    steps = grid_steps(keys)
    placed = _on_grid(keys, steps.where("step_x is not null and step_y is not null"))
    # first per cell, so that a slide full of copies is combined before it is shuffled on
    cells = placed.groupBy("slide_key", "qx", "qy").agg(F.count("*").alias("n"), F.max("off_grid").alias("off"))
    worst = cells.groupBy("slide_key").agg(F.max("off").alias("off"), F.max("n").alias("n"))
    reason = (
        F.when(F.col("fractional"), "non_integer_coords")
        .when(F.col("off"), "inconsistent_spacing")
        .when(F.col("n") > 1, "duplicate_cell")
    )
    return (
        fractional.join(steps, "slide_key")
        .join(worst, "slide_key", "left")
        .select("slide_key", "step_x", "step_y", "x0", "y0", reason.alias("reason"))
    )


def geometry_rejects(tiles: DataFrame) -> DataFrame:
    """Slides whose coordinates form no regular grid, one reason each."""
    return slide_grid(tiles).where("reason is not null").select("slide_key", "reason")


def pool_groups(tiles: DataFrame, require_complete: bool = True, value: str = "tile_index") -> DataFrame:
    """2x2 groups with members in order top-left, top-right, bottom-left, bottom-right.

    Blocks are anchored at the slide minimum and never overlap. Partial blocks
    need their top-left tile and repeat their last member up to four. The grid
    table (one row per slide) is written once and broadcast if its size allows,
    so the feature vectors are shuffled only by block.
    """
    usable = slide_grid(tiles).where("reason is null and step_x is not null and step_y is not null")
    placed = _on_grid(tiles, attach_small(settle(usable.drop("reason"))))
    corner = (F.col("qx") % 2 + 2 * (F.col("qy") % 2)).alias("corner")
    grouped = placed.groupBy(
        "slide_key", F.floor(F.col("qx") / 2).alias("gx"), F.floor(F.col("qy") / 2).alias("gy")
    ).agg(
        # a cell holds one tile, so a block collects at most four
        F.sort_array(
            F.collect_list(F.struct(corner, F.col(value).alias("value"), F.col("coord_x"), F.col("coord_y")))
        ).alias("m")
    )
    if require_complete:
        grouped = grouped.where(F.size("m") == 4)
    first = F.get("m", F.lit(0))
    grouped = grouped.where(first["corner"] == 0)
    last = F.size("m") - 1
    members = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(F.col("m"), F.least(k, last))["value"]
    )
    return grouped.select(
        "slide_key",
        "gx",
        "gy",
        first["coord_x"].alias("coord_x"),
        first["coord_y"].alias("coord_y"),
        members.alias("members"),
    )


def pooled_index(groups: DataFrame) -> DataFrame:
    """Add ``tile_index``: position by (gy, gx) within the slide, counted per grid row first."""
    before = Window.partitionBy("slide_key").orderBy("gy").rowsBetween(Window.unboundedPreceding, -1)
    rows = groups.groupBy("slide_key", "gy").agg(F.count("*").alias("n"))
    offsets = rows.select("slide_key", "gy", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("slide_key", "gy").orderBy("gx")
    ranked = groups.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["slide_key", "gy"]).withColumn(
        "tile_index", (F.col("_off") + F.col("_in")).cast("bigint")
    ).drop("_off", "_in")


_PARTS = (
    "slide_key string, gx bigint, gy bigint, n bigint, total array<double>, first_corner bigint, coord_x bigint, coord_y bigint, "
    "last_corner bigint, last array<double>"
)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of each block that a batch holds tiles of: one vector a block where its tiles lie near each other in the file.

    A block that is not whole here also keeps the vector of its last member, which may have to be repeated.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column("features")
        width = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if vectors.null_count or (width != width[0]).any():
            raise ValueError("feature vectors differ in length; filter with isolate_slides() first")
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
        keys = batch.drop_columns(["features"]).to_pandas()
        order = keys.sort_values(["slide_key", "gx", "gy", "corner"], kind="stable").index.to_numpy()
        keys, x = keys.iloc[order], x[order]
        new = (keys[["slide_key", "gx", "gy"]] != keys[["slide_key", "gx", "gy"]].shift()).any(axis=1).to_numpy()
        head = np.flatnonzero(new)
        n = np.diff(np.concatenate([head, [len(keys)]]))
        first, last = keys.iloc[head], keys.iloc[head + n - 1]
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))
        whole = pa.array(n < 4)
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(first[c].to_numpy()) for c in ("slide_key", "gx", "gy")), pa.array(n), lists(np.add.reduceat(x, head, axis=0)),
                *(pa.array(first[c].to_numpy()) for c in ("corner", "coord_x", "coord_y")), pa.array(last["corner"].to_numpy()),
                pc.if_else(whole, lists(x[head + n - 1]), None),
            ],
            names=["slide_key", "gx", "gy", "n", "total", "first_corner", "coord_x", "coord_y", "last_corner", "last"],
        )


def pool2x2(tiles: DataFrame, require_complete: bool = True) -> DataFrame:
    """Pooled tiles: mean vector of each block, placed at its top-left corner (E5).

    Vectors are summed inside the tasks and move once, by block; the blocks are numbered from key columns alone.
    """
    ship(tiles.sparkSession)
    grid = attach_small(settle(slide_grid(tiles).where("reason is null and step_x is not null and step_y is not null").drop("reason")))
    cell = ["slide_key", "gx", "gy"]
    corner = F.col("qx") % 2 + 2 * (F.col("qy") % 2)
    at = [F.floor(F.col("qx") / 2).alias("gx"), F.floor(F.col("qy") / 2).alias("gy"), corner.cast("bigint").alias("corner")]
    xy = [F.col(c).cast("bigint").alias(c) for c in ("coord_x", "coord_y")]

    keys = _on_grid(tiles.select("slide_key", "coord_x", "coord_y"), grid).select("slide_key", *at)
    blocks = keys.groupBy(*cell).agg(F.count("*").alias("n"), F.min("corner").alias("first_corner"))
    fits = (F.col("first_corner") == 0) & (F.col("n") == 4 if require_complete else F.lit(True))
    numbered = pooled_index(blocks.where(fits).select(*cell))

    parts = _on_grid(tiles.select("slide_key", "coord_x", "coord_y", "features"), grid).select("slide_key", *at, *xy, "features").where("gx is not null and gy is not null").mapInArrow(_block_sums, _PARTS)
    # a cell holds one tile, so a block has at most four parts
    met = parts.groupBy(*cell).agg(
        F.sort_array(F.collect_list(F.struct("first_corner", "coord_x", "coord_y", "n", "total", "last_corner", "last"))).alias("p")
    )
    plus = lambda u, v: F.zip_with(u, v, lambda x, y: x + y)
    total = F.aggregate(F.slice("p", 2, 3), F.get("p", F.lit(0))["total"], lambda acc, r: plus(acc, r["total"]))
    missing = F.lit(4) - F.aggregate("p", F.lit(0).cast("bigint"), lambda acc, r: acc + r["n"])
    final = F.array_max(F.transform("p", lambda r: F.struct(r["last_corner"].alias("corner"), r["last"].alias("v"))))["v"]
    filled = F.when(missing > 0, plus(total, F.transform(final, lambda v: v * missing))).otherwise(total)
    mean = F.transform(filled, lambda v: v / 4)
    place = [F.get("p", F.lit(0))[c].cast(tiles.schema[c].dataType).alias(c) for c in ("coord_x", "coord_y")]
    return met.join(numbered, cell).select("slide_key", "tile_index", *place, "gx", "gy", mean.alias("features"))


def usable_counts(tiles: DataFrame, view: str = "20x", require_complete: bool = True) -> DataFrame:
    """Usable tiles per slide in a view; slides without any keep a zero row."""
    slides = tiles.select("slide_key").distinct()
    source = tiles if view == "20x" else pool_groups(tiles, require_complete)
    counts = source.groupBy("slide_key").agg(F.count("*").alias("n"))
    return slides.join(counts, "slide_key", "left").select("slide_key", F.coalesce("n", F.lit(0)).alias("n_usable"))


def preflight(tiles: DataFrame, view: str = "10x_pool2x2", require_complete: bool = True) -> DataFrame:
    """Usable and invalid slides, total and min / median / max usable tiles."""
    counts = usable_counts(tiles, view, require_complete).where("n_usable > 0")
    invalid = geometry_rejects(tiles).agg(F.count("*").alias("n")).scalar() if view != "20x" else F.lit(0)
    return counts.agg(
        F.count("*").alias("usable_slides"),
        F.coalesce(F.sum("n_usable"), F.lit(0)).alias("tiles_total"),
        F.min("n_usable").alias("tiles_min"),
        # counts are small integers, so the percentile buffer stays short
        F.percentile("n_usable", 0.5).cast("bigint").alias("tiles_median"),
        F.max("n_usable").alias("tiles_max"),
    ).withColumn("invalid_slides", invalid.cast("bigint"))
