import numpy as np
import pytest
from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.operators import encode, mining, split, stats
from latentlake.operators.encode import LatentModel


def identity_model(spark, **rule):
    """Four identity rows and two rows of 0.25, so activations can be read off by hand."""
    rows = [(i, [1.0 if j == i else 0.0 for j in range(4)], 0.0) for i in range(4)]
    rows += [(i, [0.25] * 4, 0.0) for i in (4, 5)]
    return LatentModel(spark.createDataFrame(rows, "latent_idx bigint, w array<double>, b double"), **rule)


def tiles(spark, vectors):
    rows = [(f"S{i // 4}", i % 4, 256 * i, 0, [float(v) for v in vec]) for i, vec in enumerate(vectors)]
    return spark.createDataFrame(rows, "slide_key string, tile_index bigint, coord_x int, coord_y int, features array<float>")


TOY = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [2, 1, 0, 0], [0, -1, 0, 3]]


def test_toy_activations(spark):
    hits = encode.encode_hits(tiles(spark, TOY), identity_model(spark))
    got = {(r["slide_key"], r["tile_index"], r["latent_idx"]): r["z"] for r in hits.collect()}
    assert got[("S1", 0, 0)] == 2.0 and got[("S1", 0, 4)] == 0.75
    assert ("S1", 1, 1) not in got and got[("S1", 1, 5)] == 0.5


def test_fused_outputs_agree_with_each_other(spark):
    t, m = tiles(spark, TOY), identity_model(spark)
    hits = encode.encode_hits(t, m)
    fused = encode.encode_stats(t, m).orderBy("latent_idx").collect()
    table = stats.latent_stats(hits, t.agg(F.count("*")).scalar(), 6).orderBy("latent_idx").collect()
    assert [tuple(r) for r in fused] == [tuple(r) for r in table]
    by_slide = encode.encode_slide_stats(t, m).orderBy("slide_key", "latent_idx").collect()
    assert [tuple(r) for r in by_slide] == [tuple(r) for r in stats.slide_partials(hits).orderBy("slide_key", "latent_idx").collect()]


def test_top_candidates_survive_compaction_with_many_ties(spark, monkeypatch):
    vectors = [[1, 0, 0, 0]] * 300 + [[2, 0, 0, 0]] * 3
    rows = [(f"S{i % 7}", i, 0, 0, [float(v) for v in vec]) for i, vec in enumerate(vectors)]
    t = spark.createDataFrame(rows, "slide_key string, tile_index bigint, coord_x int, coord_y int, features array<float>")
    got = encode.encode_top(t, identity_model(spark), 6).where("latent_idx = 0").orderBy("source_rank").collect()
    want = sorted([(-v[0], f"S{i % 7}", i) for i, v in enumerate(vectors)])[:6]
    assert [(-r["z"], r["slide_key"], r["tile_index"]) for r in got] == want


def test_top_kernel_compacts_exactly():
    rng = np.random.default_rng(3)
    import pandas as pd

    frame = pd.DataFrame(
        {"latent_idx": rng.integers(0, 3, 500), "slide_key": [f"S{i}" for i in rng.integers(0, 9, 500)],
         "tile_index": np.arange(500), "z": rng.integers(0, 5, 500).astype(float)}
    )
    whole = encode._best(frame, 7)
    parts = encode._best(pd.concat([encode._best(frame.iloc[i : i + 50], 7) for i in range(0, 500, 50)]), 7)
    assert whole.reset_index(drop=True).equals(parts.reset_index(drop=True))


@pytest.mark.parametrize("magnitude", [False, True])
def test_top_mask_ties_go_to_lower_position(magnitude):
    a = np.array([[1.0, -2.0, 2.0, 2.0, 0.0]])
    keep, _ = encode.top_mask(a, 2, magnitude, False, axis=1)
    assert keep.tolist() == [[False, True, True, False, False]] if magnitude else [[False, False, True, True, False]]


def test_wrong_width_fails_with_a_clear_message(spark):
    bad = tiles(spark, [[1, 2, 3]])
    with pytest.raises(Exception, match="length 4"):
        encode.encode_hits(bad, identity_model(spark)).collect()


def test_blocked_model_gives_the_same_rows(spark, sf):
    t = fx.tiles(spark, sf)
    one = encode.encode_stats(t, fx.model(spark, sf)).orderBy("latent_idx").collect()
    many = encode.encode_stats(t, fx.model(spark, sf, block_bytes=7 * fx.D_IN * 8)).orderBy("latent_idx").collect()
    for a, b in zip(one, many, strict=True):
        assert a["nnz"] == b["nnz"] and a["z_sum"] == pytest.approx(b["z_sum"], rel=1e-12)


def test_float32_stays_close(spark, sf):
    t = fx.tiles(spark, sf)
    exact = {r["latent_idx"]: r["z_max"] for r in encode.encode_stats(t, fx.model(spark, sf)).collect()}
    quick = {r["latent_idx"]: r["z_max"] for r in encode.encode_stats(t, fx.model(spark, sf, dtype="float32")).collect()}
    assert all(quick[k] == pytest.approx(v, abs=1e-5) for k, v in exact.items())


@pytest.mark.parametrize("kind", ["dense", "topk", "batch_topk"])
@pytest.mark.parametrize("rule", [{}, {"mode": "magnitude"}, {"nonneg": True}])
def test_split_models_agree_with_one_block(spark, monkeypatch, kind, rule):
    """Ties between blocks, chunks cut by the held bytes, more hits than latents of a block."""
    monkeypatch.setattr(split, "HELD_BYTES", 200)
    monkeypatch.setattr(encode, "CHUNK_BYTES", 64)
    t = tiles(spark, TOY * 3).repartition(3)
    one = identity_model(spark, kind=kind, k=2, chunk_tiles=3, **rule)
    many = identity_model(spark, kind=kind, k=2, chunk_tiles=3, block_bytes=2 * 4 * 8, **rule)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(encode.encode_hits(t, one))
    assert rows(encode.encode_hits(t, many)) == want
    if kind != "dense":
        assert rows(split.hits(t, many)) == want
    n = t.agg(F.count("*").alias("n")).scalar()
    near = lambda r: pytest.approx(r, abs=1e-12)
    assert list(encode.encode_monitor(t, many).first()) == near(list(stats.activation_monitor(encode.encode_hits(t, one), n, 6).first()))
    for margin in (True, False):
        got = encode.encode_concept(t, many, 4, 50, margin).collect()
        table = mining.concept_tiles(encode.encode_hits(t, one), 4, 50, 6, margin, t).collect()
        assert [tuple(r)[:2] for r in got] == [tuple(r)[:2] for r in table]
        assert [r[2] for r in got] == near([r[2] for r in table])
    weights = one.encoder.select("latent_idx", "w")
    flat = {(r["slide_key"], r["tile_index"], r["dim"]): r["x_hat"] for r in encode.decode(encode.encode_hits(t, one), weights).collect()}
    for decoder in (None, weights):
        for r in encode.reconstruct(t, many, decoder).collect():
            assert r["x_hat"] == near([flat.get((r["slide_key"], r["tile_index"], d), 0.0) for d in range(4)])


def test_no_hits_are_shuffled_for_a_split_monitor(spark):
    t = tiles(spark, TOY)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    model = identity_model(spark, block_bytes=2 * 4 * 8)
    text = plan(encode.encode_monitor(t, model))
    assert text.count("Exchange") == 1 and "slide_key" not in text.split("Exchange")[0] and text.count("MapInArrow") == 1
    assert plan(encode.reconstruct(t, model)).count("Exchange") == 0


def test_expression_encode_is_bounded(spark, sf):
    with pytest.raises(ValueError):
        encode.encode_sql(fx.tiles(spark, sf), fx.encoder(spark, sf), max_latents=10)


def test_batch_topk_positions_do_not_need_dense_indexes(spark):
    """Chunks follow the order of tiles, so a gap in tile_index changes nothing."""
    model = identity_model(spark, kind="batch_topk", k=1, chunk_tiles=2)
    dense = tiles(spark, TOY[:4])
    gaps = dense.withColumn("tile_index", F.col("tile_index") * 10 + 3)
    rows = lambda t: encode.encode_hits(t, model).select("latent_idx", "z", "coord_x").collect()
    assert sorted(rows(dense)) == sorted(rows(gaps))
