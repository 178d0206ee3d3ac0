"""Connected components of an edge table by alternating large-star and small-star steps; every step is joins and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Edges that a task contracts at once.
TASK_EDGES = 200_000


def forest(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least node of each node's component for the edges of one task; ``label`` holds what earlier edges gave."""
    label = np.arange(n) if label is None else label
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above
    return label


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: each node's larger neighbours move to its least neighbour; small: its smaller ones and itself do."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def _contracted(frames):
    """The edges of a task as one star per component that they form; at most ``TASK_EDGES`` are held at once."""

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held)
        node, names = pd.factorize(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), sort=True)
        label = forest(len(names), *np.split(node, 2))
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"u": names[moved], "v": names[label[moved]]})

    held, size = [], 0
    for pdf in frames:
        held, size = [*held, pdf], size + len(pdf)
        if size > TASK_EDGES:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v); the component is its least node. Self-loops and repeats do not matter.

    Each task first contracts the edges that it holds; up to ``TASK_EDGES`` are contracted by one task. More of them end after O(log^2) rounds,
    when a round leaves the edges as they are: each node then points at its component.
    """
    edges = settle(edges.where(F.col("u") != F.col("v")).select("u", "v"))
    few = edges.count() <= TASK_EDGES
    edges = settle((edges.coalesce(1) if few else edges).mapInPandas(_contracted, edges.schema).distinct())
    if few:
        return _labels(edges)
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(*digest).first()
    while seen[0]:
        edges = settle(_star(_star(edges, large=True), large=False))
        now = edges.agg(*digest).first()
        if now == seen:
            break
        seen = now
    return _labels(edges)


def _labels(stars: DataFrame) -> DataFrame:
    pairs = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return settle(pairs.union(pairs.select(F.col("component").alias("node"), "component")).distinct())
