"""Findings of review 3: tables whose last slide is short, correlated probe features, wide vectors."""

import time

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from test_queries import ORACLES, QUERIES, table

from latentlake.catalog import fixtures as fx
from latentlake.functions import vectors
from latentlake.operators import probe, resolve


@pytest.mark.parametrize("name", ["d5_indexed_with_replacement", "g30_health_rows"])
def test_last_slide_is_short(spark, tmp_path, name):
    path = f"{tmp_path}/embeddings.parquet"
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 67").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(ORACLES[name])
    assert table(df.columns, rows) == table([d[0] for d in result.description], result.fetchall())


def test_l1_fit_of_correlated_features_is_optimal(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 40))
    x = np.hstack([base, base + 0.05 * rng.normal(size=base.shape), base + 0.05 * rng.normal(size=base.shape)])
    y = (base[:, 0] - base[:, 1] + 2 * rng.normal(size=400) > 0).astype(float)
    train = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "a array<double>, y double").coalesce(1)
    train = train.select(array_to_vector("a").alias("phi"), "y").cache()
    row = probe.optimality(train, probe.fit_probe(train, penalty="l1"), 1.0, "l1").first()
    assert row["residual"] <= 1e-4 * row["start"]


@pytest.mark.parametrize("how", ["l2", "layernorm", "input_ln"])
def test_normalising_wide_vectors_takes_linear_time(spark, how):
    x = np.random.default_rng(4).normal(size=(8, 512))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, features array<double>")
    start = time.perf_counter()
    got = np.array([r["features"] for r in vectors.normalize(df, how).orderBy("i").collect()])
    assert time.perf_counter() - start < 20
    mu, v = x.mean(1, keepdims=True), x.var(1, keepdims=True)
    want = {"l2": x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8), "layernorm": (x - mu) / (np.sqrt(v) + 1e-8), "input_ln": (x - mu) / np.sqrt(v + 1e-5)}
    assert np.allclose(got, want[how])


def test_normalising_odd_vectors(spark):
    df = spark.createDataFrame([(0, None), (1, [2.0, 2.0])], "i int, features array<double>")
    got = [r["features"] for r in vectors.normalize(df, "input_ln").orderBy("i").collect()]
    assert got == [None, [0.0, 0.0]]


def test_tasks_for_distinct_keys_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fx, "KEY_ROWS", 200, raising=False)
    sizes = [r["n"] for r in fx.sparse_keys(spark, SF).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_suppkey", "l_orderkey * 8 + l_linenumber").distinct().count()
    assert max(sizes) < 400


def test_tasks_for_moved_paths_follow_the_paths(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PATHS_A_TASK", 10, raising=False)
    paths = spark.range(400).selectExpr("concat('/old/features/', id, '.h5') as path")
    out = resolve.remap_paths(paths, paths.where("path like '%7.h5'"), ["/lake"])
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and max(sizes) < 40
    assert out.where("how = 'exact'").count() == 40
