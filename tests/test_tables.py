import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from latentlake import schemas
from latentlake.catalog import fixtures as fx
from latentlake.functions import ids
from latentlake.operators import analytics, latent_map, order_stats, probe, registry, resolve, stats
from latentlake.plans import workflows
from latentlake.runtime import every_pair, left_known, scratch_path
from latentlake.sources import readers, writers
from latentlake.streaming import incremental


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("/a/TCGA-AB-1234-01Z-00-DX1.uuid.h5", "TCGA-AB-1234-01Z-00-DX1"),
        ("tcga-ab-1234-01z-00-dxa_x.svs", "TCGA-AB-1234-01Z-00-DXA"),
        ("plain.name.h5", "PLAIN"),
        ("", ""),
    ],
)
def test_slide_id(spark, text, want):
    assert one(spark, ids.slide_id(F.lit(text))) == want


def test_unknown_encoder_raises(spark):
    with pytest.raises(Exception, match="unsupported encoder"):
        one(spark, ids.canonical_encoder(F.lit("resnet")))


def test_letter_slides_also_try_their_number(spark):
    got = one(spark, ids.candidate_names(F.lit("/x/TCGA-AB-1234-01Z-00-DXC.u.h5")))
    assert got == [
        "TCGA-AB-1234-01Z-00-DXC.u.h5", "TCGA-AB-1234-01Z-00-DXC.h5", "TCGA-AB-1234-01Z-00-DX3.h5",
    ]


def test_manifest_without_a_required_split_raises(spark):
    docs = spark.createDataFrame([('{"train": ["/a/x.h5"], "test": []}',)], "value string")
    assert readers.parse_splits(docs).count() == 1
    with pytest.raises(KeyError):
        readers.parse_splits(docs, required=("train", "test"))


def test_absent_csv_is_an_empty_table(spark):
    got = readers.read_csv_table(spark, "/tmp/none-such-file.csv", ["a", "b"])
    assert got.columns == ["a", "b"] and got.count() == 0


def test_csv_roundtrip_keeps_quotes_and_blanks(spark):
    path = scratch_path(spark, "csv")
    rows = [("a,b", 'say "x"', None), ("", "2", "z")]
    writers.write_csv(spark.createDataFrame(rows, "p string, q string, r string"), path, ["q", "p", "r", "s"])
    got = {tuple(r) for r in readers.read_csv_table(spark, path, ["q", "p", "r", "s"]).collect()}
    assert got == {('say "x"', "a,b", "", ""), ("2", "", "z", "")}


def test_registry_counts_on_one_missing_one_extra_one_duplicate(spark):
    slides = spark.createDataFrame(
        [("A", "", "/s/A.svs", 0), ("B", "", "/s/B.svs", 1), ("D", "", "/s/D1.svs", 2), ("D", "", "/s/D2.svs", 3)],
        "slide_id string, slide_filename string, wsi_path string, ord int",
    )
    feats = spark.createDataFrame(
        [("A", "C1", "uni2", "/f/A.h5", 0), ("X", "C1", "seal", "/f/X.h5", 1), ("D", "C1", "seal", "/f/D.h5", 2)],
        "slide_id string, cohort string, encoder string, path string, ord int",
    )
    counts = registry.registry_counts(registry.load_slides(slides), registry.load_features(feats)).first()
    assert (counts["missing_slides"], counts["missing_features"], counts["ambiguous_slides"]) == (1, 1, 1)
    assert counts["mapping_rows"] == 3


def test_remap_prefers_the_wanted_encoder_and_falls_back_to_prefix(spark):
    paths = spark.createDataFrame([("/old/TCGA-ACC/TCGA-AB-1234-01Z-00-DX1.u.h5",), ("/old/TCGA-ACC/zz.h5",)], "path string")
    folder = "/lake/wsi_features/{}/TCGA/ACC/h5/{}"
    listing = spark.createDataFrame(
        [(folder.format("uni2", "TCGA-AB-1234-01Z-00-DX1.h5"),), (folder.format("seal", "TCGA-AB-1234-01Z-00-DX1.h5"),),
         (folder.format("uni2", "zz_b.h5"),), (folder.format("uni2", "zz_a.h5"),)], "path string",
    )
    got = {r["path"]: (r["resolved"], r["how"]) for r in resolve.remap_paths(paths, listing, ["/lake"], preferred="seal").collect()}
    assert got["/old/TCGA-ACC/TCGA-AB-1234-01Z-00-DX1.u.h5"] == (folder.format("seal", "TCGA-AB-1234-01Z-00-DX1.h5"), "candidate")
    assert got["/old/TCGA-ACC/zz.h5"] == (folder.format("uni2", "zz_a.h5"), "prefix")


def test_histogram_matches_numpy(spark):
    values = [0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0, 0.99]
    rows = [("s", 1, "selected", v, int(v > 0)) for v in values] + [("s", 2, "selected", 0.0, 0)]
    df = spark.createDataFrame(
        rows, "latent_strategy string, latent_idx int, latent_group string, slide_max_activation double, fires int"
    )
    got = {r["latent_idx"]: r for r in analytics.histograms(df, 4).collect()}
    counts, edges = np.histogram(values, bins=4, range=(0.0, 1.0))
    assert got[1]["counts"] == counts.tolist() and got[1]["bin_edges"] == pytest.approx(edges.tolist())
    assert got[2]["counts"] == [1, 0, 0, 0] and got[2]["bin_edges"][-1] == 1.0


def test_sparse_percentile_matches_numpy(spark):
    rng = np.random.default_rng(0)
    dense = np.where(rng.random((50, 4)) < 0.4, rng.random((50, 4)), 0.0)
    dense[:, 3] = 0.0
    hits = spark.createDataFrame(
        [("S", int(t), int(j), float(dense[t, j])) for t, j in np.argwhere(dense > 0)],
        "slide_key string, tile_index bigint, latent_idx bigint, z double",
    )
    sampled = spark.range(50).selectExpr("'S' as slide_key", "id as tile_index")
    got = {r["latent_idx"]: r["clamp_value"] for r in stats.percentile_clamp(hits, sampled, 80.0, 4).collect()}
    assert [got[j] for j in range(4)] == pytest.approx(np.percentile(dense, 80, axis=0).tolist())


@pytest.mark.parametrize(("bins", "few"), [(1024, 2048), (4, 3), (2, 1)])
def test_rank_selection(spark, bins, few):
    """Ties, repeated values, values of very different size, one value alone, empty values, ranks out of range; no buffer of values in the plan."""
    rng = np.random.default_rng(bins)
    groups = {1: rng.normal(size=300), 2: np.repeat([5.0, -2.0], 80), 3: 10.0 ** rng.integers(*((-300, 300) if bins > 100 else (-4, 4)), 60), 4: np.array([7.5]), 5: np.r_[np.zeros(200), rng.random(5)]}
    freq = {g: rng.integers(1, 4, len(v)) for g, v in groups.items()}
    rows = [(g, float(z), int(f)) for g, v in groups.items() for z, f in zip(v, freq[g], strict=True)] + [(5, float("nan"), 1), (5, None, 4), (6, None, 1)]
    values = spark.createDataFrame(rows, "g int, z double, freq long")
    wanted = [(g, r) for g in (*groups, 6, 7) for r in (-1, 0, 1, 17, 100, 159, 10_000)]
    got = {(r["g"], r["rank"]): r["value"] for r in order_stats.at_ranks(values, spark.createDataFrame(wanted, "g int, rank long"), "g", bins, few).collect()}
    flat = {g: np.sort(np.repeat(v, freq[g])) for g, v in groups.items()}
    assert got == {(g, r): flat[g][r] for g, r in wanted if g in flat and 0 <= r < len(flat[g])}
    found = order_stats.percentiles(values, 37.5, "g", bins=bins, few=few)
    assert {r["g"]: r["value"] for r in found.collect()} == pytest.approx({g: np.percentile(v, 37.5) for g, v in flat.items()}, rel=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_sparse_slide_features(spark):
    """Silent slides have an empty vector, all-firing latents keep a negative maximum, unlabelled slides go; no skeleton in the plan."""
    rows = [("a", 1, 2.0, 6.0, 3), ("a", 3, -1.0, -4.0, 4), ("b", 0, 5.0, 5.0, 1), ("x", 0, 1.0, 1.0, 1)]
    partials = spark.createDataFrame(rows, "slide_key string, latent_idx bigint, z_max double, z_sum double, nz_n bigint")
    counts = spark.createDataFrame([("a", 4), ("b", 2), ("c", 3), ("x", 1), ("e", 0)], "slide_key string, total_tiles bigint")
    matched = spark.createDataFrame([("a", "train", 1), ("b", "test", 0), ("c", "train", 0), ("x", "train", None), ("e", "train", 1)], "slide_key string, split string, y int")
    found = probe.probe_dataset(partials, counts, matched, 4)
    got = {r["slide_key"]: (r["y"], dict(zip(r["phi"].indices.tolist(), r["phi"].values.tolist(), strict=True)), len(r["phi"])) for r in found.collect()}
    assert got == {
        "a": (1.0, {1: 1.5, 3: -1.0, 5: 2.0, 7: -1.0, 9: 0.75, 11: 1.0}, 12),
        "b": (0.0, {0: 2.5, 4: 5.0, 8: 0.5}, 12), "c": (0.0, {}, 12),
    }
    assert "sequence(" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_key_are_spread(spark):
    """The rows of a plain left join, without a partition that takes all null keys."""
    rows = spark.range(8000).selectExpr("id", "case when id % 4 = 0 then concat('k', id % 5) when id % 4 = 1 then '' when id % 4 = 2 then ' ' end as k", "'x' as j")
    dims = spark.createDataFrame([("k1", "x", 10), ("k3", "x", 30), (None, "x", 1), ("", "x", 2)], "k string, j string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = left_known(rows, dims, ["k", "j"])
        assert got.columns == ["id", "k", "j", "v"]
        held = got.groupBy(F.spark_partition_id()).count()
        assert held.agg(F.max("count")).first()[0] < 0.6 * 8000
        want = {i: {1: 10, 3: 30}.get(i % 5) if i % 4 == 0 else None for i in range(8000)}
        assert {r["id"]: r["v"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("block_rows", [10_000, 3])
def test_every_pair(spark, block_rows):
    """One array or many salted blocks: the same pairs, repeated rows kept, repeated items once, nulls on both sides."""
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "k string, v int")
    items = spark.createDataFrame([(i % 10, f"x{i % 10}" if i % 10 else None) for i in range(15)], "i int, name string")
    got = Counter(map(tuple, every_pair(rows, items, block_rows).collect()))
    assert got == Counter((*r, i, f"x{i}" if i else None) for r in map(tuple, rows.collect()) for i in range(10))
    assert every_pair(rows, items.where("i > 99"), block_rows).collect() == []
    plan = every_pair(rows, items, block_rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_more_label_values_than_an_array_holds(spark):
    """200,000 values of one label give a row each."""
    slides = spark.range(1000).selectExpr("concat('c', id) as case_id")
    labels = spark.range(200_000).selectExpr("concat('c', id % 1000) as case_id", "'site' as label_column", "concat('v', id) as label_value")
    selected = spark.createDataFrame([("top", 7, "")], "latent_strategy string, latent_idx bigint, latent_group string")
    scores = slides.selectExpr("'top' as latent_strategy", "7L as latent_idx", "'' as latent_group", "case_id", "if(case_id < 'c5', 1.0D, 0.0D) as slide_max_activation")
    out = analytics.label_enrichment(scores, slides, labels, selected)
    row = out.agg(F.count("*"), F.count_distinct("label_value"), F.sum("cases_in_label"), F.sum("cases_with_activation")).first()
    assert tuple(row) == (200_000, 200_000, 200_000, scores.where("slide_max_activation > 0").count() * 200)


def test_probe_optimum_has_a_zero_gradient(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0.3).astype(float)
    train = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "a array<double>, y double")
    scaler, model, n = probe.fit_probe(train.select(array_to_vector("a").alias("phi"), "y"), c=0.7, tol=1e-12)
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    coef, bias = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(z @ coef + bias)))
    gradient = z.T @ (w * (p - y)) + coef / 0.7
    assert np.abs(gradient).max() < 1e-4 and abs((w * (p - y)).sum()) < 1e-4


def test_probe_needs_enough_slides(spark):
    few = spark.createDataFrame([([1.0], 1.0), ([0.0], 0.0)], "a array<double>, y double").select(array_to_vector("a").alias("phi"), "y")
    with pytest.raises(ValueError):
        probe.fit_probe(few)


def test_metrics_with_one_class(spark):
    preds = spark.createDataFrame([("a", 1, 0.9, 1), ("a", 1, 0.2, 0)], "split string, y int, prob_pos double, pred int")
    row = probe.probe_metrics(preds).first()
    assert math.isnan(row["auc"]) and math.isnan(row["specificity"]) and row["recall"] == 0.5 == row["balanced_acc"]


def test_map_of_a_single_live_latent(spark):
    decoder = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "latent_idx bigint, w array<double>")
    got = latent_map.latent_map(decoder, spark.range(1).selectExpr("id as latent_idx")).collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 0.0)]


def test_map_matches_numpy_pca(spark):
    rng = np.random.default_rng(5)
    w = rng.normal(size=(12, 4)) * [3, 2, 1, 0.5]
    decoder = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "latent_idx bigint, w array<double>")
    got = {r["latent_idx"]: (r["map_x"], r["map_y"]) for r in latent_map.latent_map(decoder, decoder).collect()}
    centred = w - w.mean(0)
    axes = np.linalg.svd(centred)[2][:2]
    axes = np.array([a if a[np.abs(a).argmax()] > 0 else -a for a in axes])
    assert np.allclose([got[i] for i in range(12)], centred @ axes.T, atol=1e-8)


def test_stream_equals_batch_and_replay_is_idempotent(spark, sf):
    source, target, ck = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    acts = fx.acts(spark, sf).select("latent_idx", "z")
    acts.repartition(4).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(acts.schema).option("maxFilesPerTrigger", 1).parquet(source)
        incremental.incremental_stats(stream, target, ck).awaitTermination()
    got = {r["latent_idx"]: (r["z_max"], r["n_rows"]) for r in incremental.read_incremental(spark, target).collect()}
    want = {r["latent_idx"]: (r["z_max"], r["n_rows"]) for r in incremental.batch_partials(acts).collect()}
    assert got == want
    folded = scratch_path(spark, "fold")
    incremental.compact(spark, target, folded)
    assert incremental.read_incremental(spark, folded).count() == len(want)


def test_folded_stream_state(spark):
    """Folds every few batches; a replay, a fold that was cut off before its commit and one cut off after it change nothing; the folder stays bounded."""
    path = scratch_path(spark, "folded")
    store = incremental.StatsStore(spark, path, fold_every=3)
    batch = lambda i: spark.createDataFrame([(i % 2, float(i)), (7, 1.0)], "latent_idx bigint, z double").coalesce(1)
    spark.range(1).selectExpr("99L as latent_idx", "1e9D as z_max").write.parquet(f"{path}/base/through=5")  # left by a lost driver
    for i in range(20):
        store.write(batch(i), i)
        if i in (4, 8):
            store.write(batch(i), i)  # replayed; 8 is replayed behind its fold
        rows = {r["latent_idx"]: (r["z_max"], r["z_sum"], r["n_rows"]) for r in incremental.read_incremental(spark, path).collect()} if i in (4, 5, 8, 19) else None
        if rows is not None:
            want = {7: (1.0, i + 1.0, i + 1)} | {k: (float(v[-1]), float(sum(v)), len(v)) for k, v in ((k, list(range(k, i + 1, 2))) for k in (0, 1)) if v}
            assert rows == want, i
    assert store.through() == 17
    held = [store._numbers(f) for f in ("delta", "base", "manifest")]
    assert held == [[15, 16, 17, 18, 19], [14, 17], [14, 17]]
    again = incremental.StatsStore(spark, path, fold_every=3)
    again.write(batch(20), 20)
    assert again.through() == 20 and again.read().where("latent_idx = 7").first()["n_rows"] == 21
    with pytest.raises(ValueError):
        incremental.StatsStore(spark, path, 0)


def test_bundle_roundtrip(spark, sf):
    from latentlake.catalog.flows import CFG, RUN, _inputs

    tiles, slides, model, parents = _inputs(spark, sf)
    bundle = workflows.representatives_bundle(tiles, slides, model, CFG, RUN, parents, root="/lake")
    folder = scratch_path(spark, "bundle")
    workflows.write_bundle(bundle, folder)
    selected, reps, support = readers.read_bundle(spark, folder)
    assert reps.columns == schemas.SUPPORT_COLUMNS
    assert support.count() == 4 * bundle["latent_summary"].agg(F.sum("support_tile_count")).first()[0]
    want = {(r["latent_strategy"], r["latent_idx"]) for r in bundle["selected"].collect()}
    assert {(r["latent_strategy"], r["latent_idx"]) for r in selected.collect()} == want
    assert all(r["latent_group"].startswith("parent_") for r in selected.collect())


def test_pooled_mining_and_analytics_tables(spark, sf):
    from dataclasses import replace

    from latentlake.catalog.flows import CFG, _inputs

    tiles, slides, model, parents = _inputs(spark, sf)
    cfg = replace(CFG, magnification="10x_pool2x2", slides_per_project=2, tiles_per_slide=3)
    mined = workflows.mine(tiles, slides, model, cfg, parents)
    assert mined["top_tiles"].count() > 0 and mined["stats"].first()["n_tiles"] <= 3 * 2 * 6
    assert mined["hierarchy"].agg(F.sum("child_count")).first()[0] == fx.LATENTS
    labels = slides.selectExpr("case_id", "split as part", "1 as ord").distinct()
    tables = workflows.analytics_tables(
        tiles, slides, model, mined["selected"], fx.LATENTS, labels=labels, decoder=model.encoder, bins=8
    )
    assert tables["all_latent_metrics"].columns == schemas.LATENT_METRIC_COLUMNS
    assert tables["all_latent_metrics"].count() == fx.LATENTS
    assert {len(r["counts"]) for r in tables["selected_latent_histograms"].collect()} == {8}
    assert tables["case_label_enrichment"].select("label_value").distinct().count() == 2
    assert tables["latent_map"].count() == tables["all_latent_metrics"].where("is_alive = 1").count()


def test_analytics_in_the_magnification_of_the_run(spark, sf):
    """The 10x tables are those of the pooled tiles; slides without a grid are reported."""
    from latentlake.catalog.flows import CFG, _inputs
    from latentlake.operators import pooling

    _, slides, model, parents = _inputs(spark, sf)
    tiles = fx.grid_tiles(spark, sf)
    selected = spark.createDataFrame([("top_activation", 3, ""), ("top_activation", 11, "")], "latent_strategy string, latent_idx bigint, latent_group string")
    got = workflows.analytics_tables(tiles, slides, model, selected, fx.LATENTS, magnification="10x_pool2x2")
    want = workflows.analytics_tables(pooling.pool2x2(tiles), slides, model, selected, fx.LATENTS)
    rows = lambda t: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()), key=str)
    for name in ("selected_latent_slide_stats", "all_latent_metrics"):
        assert rows(got[name]) == rows(want[name])
    assert {r["slide_key"] for r in got["rejects"].collect()} == {r["slide_key"] for r in pooling.geometry_rejects(tiles).collect()} != set()


def test_exported_slides_have_a_draw_of_their_own(spark, sf):
    from dataclasses import replace

    from latentlake.catalog.flows import CFG, RUN, _inputs
    from latentlake.operators import sampling

    assert workflows.BUNDLE_CONFIG.slides_per_project == 200
    tiles, slides, model, parents = _inputs(spark, sf)
    cfg = replace(CFG, slides_per_project=1, per_slide=0, min_px=0)
    bundle = workflows.representatives_bundle(tiles, slides, model, cfg, RUN, parents)
    drawn = sampling.cap_slides(slides.where("split = 'test'").selectExpr("slide_key", "cohort as project"), 1, cfg.seed + 1)
    used = {r["slide_key"] for r in bundle["representative_support_tiles"].select("slide_key").distinct().collect()}
    assert used and used <= {r["slide_key"] for r in drawn.collect()}
    row = bundle["bundle_summary"].first()
    assert row["available_latent_strategies"] == list(cfg.strategies) and row["export_split"] == "test" and len(row["available_representative_methods"]) == 4


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_feature_index_sink_and_listing(spark, sf):
    """The index is partitioned by encoder and cohort, and its files can be listed without reading them."""
    from latentlake.catalog import fixtures as fx
    from latentlake.sources import readers, writers

    path = scratch_path(spark, "index")
    tiles = fx.tiles(spark, sf)
    writers.write_feature_index(tiles, path)
    assert spark.read.parquet(path).count() == tiles.select("encoder", "cohort", "slide_key").distinct().count()
    files = [r["path"] for r in readers.read_file_listing(spark, path, "*.parquet").collect()]
    assert files and all("/encoder=" in f and "/cohort=" in f for f in files)
