"""Deterministic samples: an md5 key per (seed, phase, row) replaces random draws.

Samples are planned on the key columns alone and then applied to the full rows as
filters; ``tile_index`` is unique within a slide (health() reports where it is not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake.functions.hashing import draw_int, draw_key
from latentlake.runtime import attach_small, settle

KEYS = ("slide_key", "tile_index")
#: Rows per block when positions are counted inside one slide.
POSITION_BLOCK = 4096
_HEX_PREFIX = 4


def cap_tiles(tiles: DataFrame, n: int, seed: int, phase: str) -> DataFrame:
    """At most ``n`` tiles per slide; ``n <= 0`` keeps all.

    A first pass over the key columns finds each slide's n-th smallest key
    (``row_number() <= n`` is limited below the shuffle, so a giant slide sends
    n narrow rows per task); the second pass is a filter against that table of
    one row per slide. Feature vectors are never shuffled.
    """
    if n <= 0:
        return tiles
    return _below_cut(tiles, settle(_cuts(tiles.select(*KEYS), n, seed, phase)), seed, phase)


def _cuts(keys: DataFrame, n: int, seed: int, phase: str) -> DataFrame:
    order = Window.partitionBy("slide_key").orderBy("_key", "tile_index")
    keyed = keys.withColumn("_key", draw_key(seed, phase, *KEYS)).withColumn("_rn", F.row_number().over(order))
    return keyed.where(F.col("_rn") <= n).groupBy("slide_key").agg(F.max(F.struct("_key", "tile_index")).alias("_cut"))


def _below_cut(tiles: DataFrame, cuts: DataFrame, seed: int, phase: str) -> DataFrame:
    mine = F.struct(draw_key(seed, phase, *KEYS).alias("_key"), F.col("tile_index"))
    return tiles.join(attach_small(cuts), "slide_key").where(mine <= F.col("_cut")).select(*tiles.columns)


def cap_slides(slides: DataFrame, per_project: int | None, seed: int, project: str = "project") -> DataFrame:
    """At most ``per_project`` slides per project, with a shuffled output position key."""
    keyed = slides.withColumn("_key", draw_key(seed, F.col(project), "slide_key"))
    if per_project is not None and per_project >= 0:
        order = Window.partitionBy(project).orderBy("_key", "slide_key")
        keyed = keyed.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_project).drop("_rn")
    return keyed.withColumn("shuffle_key", draw_key(seed, "out", "slide_key")).drop("_key")


def tile_position(tiles: DataFrame, key: str = "slide_key", order: str = "tile_index", name: str = "pos") -> DataFrame:
    """Zero-based position of each row within its slide by ``order``.

    Counted in two levels (blocks of the order column, then rows in a block) so
    that one huge slide is spread over many tasks.
    """
    block = F.floor(F.col(order) / POSITION_BLOCK)
    tagged = tiles.withColumn("_blk", block)
    before = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(key, "_blk")
        .agg(F.count("*").alias("_n"))
        .select(key, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(key, "_blk").orderBy(order)
    ranked = tagged.withColumn("_in", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, [key, "_blk"])
    return joined.withColumn(name, (F.col("_off") + F.col("_in")).cast("bigint")).drop("_blk", "_in", "_off")


def _counts(tiles: DataFrame) -> DataFrame:
    return settle(tiles.groupBy("slide_key").agg(F.count("*").cast("bigint").alias("_n")))


def _short_slides(tiles: DataFrame, wanted: DataFrame, seed: int, replace: bool) -> DataFrame:
    """Slides with fewer tiles than asked: all their tiles, or hash draws with replacement.

    ``wanted`` is (slide_key, _n, _k[, chunk]) of the short slides only.
    """
    extra = [c for c in ("chunk",) if c in wanted.columns]
    keys = tiles.select(*KEYS).join(attach_small(wanted.select("slide_key").distinct()), "slide_key", "left_semi")
    if replace:
        draws = wanted.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1)))
        pick = draw_int(F.col("_n"), seed, "replace", "slide_key", "draw", *extra)
        picks = draws.withColumn("pos", pick).join(tile_position(keys), ["slide_key", "pos"])
    else:
        picks = keys.join(wanted, "slide_key").withColumn("draw", F.col("tile_index"))
    return tiles.join(attach_small(settle(picks.select(*KEYS, *extra, "draw"))), list(KEYS))


def sample_indexed(tiles: DataFrame, k: int, seed: int, replace: bool = True) -> DataFrame:
    """k tiles per slide without replacement; short slides draw with replacement.

    ``draw`` tells repeated draws of one tile apart.
    """
    counts = _counts(tiles)
    long = tiles.select(*KEYS).join(attach_small(counts.where(F.col("_n") >= k)), "slide_key", "left_semi")
    full = _below_cut(tiles, settle(_cuts(long, k, seed, "indexed")), seed, "indexed")
    wanted = counts.where(F.col("_n") < k).withColumn("_k", F.lit(k).cast("bigint"))
    short = _short_slides(tiles, wanted, seed, replace)
    return full.withColumn("draw", F.col("tile_index")).unionByName(short)


def sample_slice(tiles: DataFrame, k: int, seed: int, replace: bool = True) -> DataFrame:
    """k consecutive tiles from a hash-derived start; short slides as in sample_indexed (D3)."""
    return _slices(tiles, _counts(tiles).withColumn("_k", F.lit(k).cast("bigint")), seed, "slice", replace)


def sample_multislice(tiles: DataFrame, k: int, chunks: int, seed: int, replace: bool = True) -> DataFrame:
    """k tiles per slide split over ``chunks`` slices; the first ``k % chunks`` get one more."""
    chunks = max(1, chunks)
    size = F.lit(k // chunks) + F.when(F.col("chunk") < k % chunks, 1).otherwise(0)
    wanted = _counts(tiles).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    wanted = wanted.withColumn("_k", size.cast("bigint")).where(F.col("_k") > 0)
    return _slices(tiles, wanted, seed, "multislice", replace)


def _slices(tiles: DataFrame, wanted: DataFrame, seed: int, phase: str, replace: bool) -> DataFrame:
    """Contiguous runs as tile_index ranges, one row per slide and chunk, filtered by a small join."""
    extra = [c for c in ("chunk",) if c in wanted.columns]
    start = draw_int(F.col("_n") - F.col("_k") + 1, seed, phase, "slide_key", *extra)
    long = wanted.where(F.col("_n") >= F.col("_k")).withColumn("_start", start)
    placed = tile_position(tiles.select(*KEYS)).join(attach_small(long), "slide_key")
    inside = placed.where(F.col("pos").between(F.col("_start"), F.col("_start") + F.col("_k") - 1))
    ranges = settle(inside.groupBy("slide_key", *extra).agg(F.min("tile_index").alias("_lo"), F.max("tile_index").alias("_hi")))
    full = tiles.join(attach_small(ranges), "slide_key").where(F.col("tile_index").between(F.col("_lo"), F.col("_hi")))
    full = full.drop("_lo", "_hi").withColumn("draw", F.col("tile_index"))
    short = _short_slides(tiles, wanted.where(F.col("_n") < F.col("_k")), seed, replace)
    return full.unionByName(short)


def uniform_sample(df: DataFrame, k: int, seed: int, key: list[str]) -> DataFrame:
    """Uniform sample of exactly ``min(k, n)`` rows: the k smallest hash keys.

    Hash prefixes are counted first; whole prefixes below the k-th key pass a plain
    filter and only the one boundary prefix is ranked, so neither a task nor the
    driver ever holds the sample. ``k < 0`` keeps all.
    """
    if k < 0:
        return df
    keyed = df.withColumn("_key", draw_key(seed, "sample", *key))
    prefix = F.substring("_key", 1, _HEX_PREFIX)
    counts = keyed.groupBy(prefix.alias("_p")).agg(F.count("*").alias("_c"))
    # at most 16**4 prefixes meet in this window
    running = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.select("_p", "_c", F.sum("_c").over(running).alias("_cum"))
    edge = upto.where(F.col("_cum") - F.col("_c") < k).agg(
        F.max("_p").alias("p"), F.max(F.struct("_p", F.lit(k) - (F.col("_cum") - F.col("_c")))).alias("s")
    )
    edge = settle(edge)
    last = edge.select("p").scalar()
    spare = edge.select(F.col("s.col2")).scalar()
    inside = keyed.where(prefix < last)
    order = Window.partitionBy("_p").orderBy("_key", *key)
    rim = keyed.where(prefix == last).withColumn("_p", prefix)
    rim = rim.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= spare).drop("_rn", "_p")
    return inside.unionByName(rim).drop("_key")
