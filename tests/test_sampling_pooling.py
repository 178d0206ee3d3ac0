import pytest
from pyspark.sql import functions as F

from latentlake.operators import filters, pooling, sampling


def tiles(spark, slides=3, n=30):
    return spark.range(slides * n).selectExpr(f"concat('S', id div {n}) as slide_key", f"id % {n} as tile_index")


def test_caps_are_exact_and_repeatable(spark):
    t = tiles(spark)
    one = sampling.cap_tiles(t, 7, 1, "a").collect()
    assert sorted(one) == sorted(sampling.cap_tiles(t.repartition(5), 7, 1, "a").collect())
    assert sorted(one) != sorted(sampling.cap_tiles(t, 7, 1, "b").collect())
    assert len(one) == 21
    assert sampling.cap_tiles(t, 0, 1, "a").count() == 90


def test_capped_hot_slide_is_limited_below_the_shuffle(spark):
    hot = spark.range(5000).selectExpr("if(id % 3 = 0, 'HOT', concat('S', id)) as slide_key", "id as tile_index")
    cuts = sampling._cuts(hot, 10, 1, "x")
    assert "WindowGroupLimit" in cuts._jdf.queryExecution().executedPlan().toString()
    out = sampling.cap_tiles(hot, 10, 1, "x")
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("slide_key = 'HOT'").count() == 10


@pytest.mark.parametrize("k", [1, 17, 89, 90, 500])
def test_uniform_sample_has_exact_size(spark, k):
    got = sampling.uniform_sample(tiles(spark), k, 5, ["slide_key", "tile_index"])
    assert got.count() == min(k, 90) == got.distinct().count()


def test_positions_span_blocks(spark):
    t = spark.range(20_000).selectExpr("'S' as slide_key", "id * 3 + 1 as tile_index")
    got = sampling.tile_position(t).orderBy("tile_index").select("pos").collect()
    assert [r["pos"] for r in got] == list(range(20_000))


def test_slices_are_contiguous(spark):
    got = sampling.sample_slice(tiles(spark), 8, 2).groupBy("slide_key").agg(
        F.count("*").alias("n"), (F.max("tile_index") - F.min("tile_index")).alias("span")
    )
    assert {(r["n"], r["span"]) for r in got.collect()} == {(8, 7)}


def test_multislice_sizes_and_short_slides(spark):
    got = sampling.sample_multislice(tiles(spark, n=6), 20, 3, 4).groupBy("slide_key", "chunk").count().collect()
    assert {(r["chunk"], r["count"]) for r in got} == {(0, 7), (1, 7), (2, 6)}


def grid(spark, points, kind="int"):
    rows = [("S", i, x, y, [float(i), 1.0]) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(
        rows, f"slide_key string, tile_index bigint, coord_x {kind}, coord_y {kind}, features array<float>"
    )


def members(df):
    return [r["members"] for r in df.orderBy("gy", "gx").collect()]


def test_complete_block(spark):
    t = grid(spark, [(0, 0), (256, 0), (0, 256), (256, 256)])
    assert members(pooling.pool_groups(t)) == [[0, 1, 2, 3]]
    pooled = pooling.pool2x2(t).first()
    assert pooled["features"] == [1.5, 1.0] and pooled["tile_index"] == 0


def test_vectors_move_once(spark):
    """Without automatic broadcasts one exchange carries vectors; tiles of a block in different partitions give the same means."""
    cells = [(x, y) for y in range(0, 5) for x in range(0, 7) if (x, y) not in ((3, 2), (4, 4))]
    t = grid(spark, [(256 * x, 256 * y) for x, y in cells])
    want = {(r["slide_key"], r["tile_index"]): r for r in pooling.pool2x2(t.coalesce(1), require_complete=False).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pooled = pooling.pool2x2(t.repartition(7, "tile_index"), require_complete=False)
        text = pooled._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert {(r["slide_key"], r["tile_index"]): r for r in pooled.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [part for part in text.split("\n\n") if ") Exchange\n" in f"{part}\n"]
    carry = [part for part in exchanges if "total" in part.split("\n")[1] or "p#" in part.split("\n")[1] or "buf#" in part.split("\n")[1]]
    assert exchanges and len(carry) == 1


def test_three_corner_block(spark):
    t = grid(spark, [(0, 0), (256, 0), (0, 256)])
    assert members(pooling.pool_groups(t)) == []
    assert members(pooling.pool_groups(t, require_complete=False)) == [[0, 1, 2, 2]]


def test_block_without_top_left_is_dropped(spark):
    t = grid(spark, [(0, 0), (256, 0), (0, 256), (256, 256), (768, 0), (512, 256)])
    assert members(pooling.pool_groups(t, require_complete=False)) == [[0, 1, 2, 3]]


def test_geometry_reasons(spark):
    reason = lambda t: [r["reason"] for r in pooling.geometry_rejects(t).collect()]
    square = [(0, 0), (256, 0), (0, 256), (256, 256)]
    assert reason(grid(spark, square)) == []
    assert reason(grid(spark, square + [(256, 256)])) == ["duplicate_cell"]
    assert reason(grid(spark, square + [(600, 0)])) == ["inconsistent_spacing"]
    assert reason(grid(spark, [(0.0, 0.0), (256.5, 0.0), (0.0, 256.0)], "double")) == ["non_integer_coords"]


def test_steps_across_coordinate_blocks(spark):
    t = grid(spark, [(4000, 0), (4100, 0), (4000, 5000), (9000, 9996)])
    row = pooling.grid_steps(t).first()
    assert (row["step_x"], row["step_y"]) == (100, 4996)


def test_single_row_gives_no_groups(spark):
    t = grid(spark, [(0, 0), (256, 0), (512, 0)])
    assert pooling.pool_groups(t).count() == 0
    assert pooling.preflight(t).first()["usable_slides"] == 0


def test_no_usable_slides_is_an_error(spark):
    t = grid(spark, [(0, 0), (256, 0)])
    counts = pooling.usable_counts(t, "10x_pool2x2")
    with pytest.raises(ValueError):
        filters.drop_empty(t.select("slide_key").distinct(), counts)
