"""Two-dimensional map of the live latents' decoder vectors."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latent_map(decoder: DataFrame, alive: DataFrame) -> DataFrame:
    """``(latent_idx, map_x, map_y)`` by centred PCA of decoder rows (M6).

    ``decoder`` is (latent_idx, w). One live latent sits at the origin. The sign of
    an axis is fixed so that its largest loading is positive.
    """
    live = decoder.join(alive.select("latent_idx"), "latent_idx", "left_semi")
    count = live.limit(2).count()
    if count < 2:
        return live.select("latent_idx", F.lit(0.0).alias("map_x"), F.lit(0.0).alias("map_y"))
    vec = live.select("latent_idx", F.transform("w", lambda x: x.cast("double")).alias("v"))
    model = PCA(k=2, inputCol="x", outputCol="pc").fit(vec.select(array_to_vector("v").alias("x")))
    axes = model.pc.toArray()
    center = [float(m) for m in _mean(vec, axes.shape[0])]
    signs = [1.0 if axes[abs(axes[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    shifted = F.zip_with("v", F.array(*[F.lit(m) for m in center]), lambda a, b: a - b)
    placed = model.transform(vec.select("latent_idx", array_to_vector(shifted).alias("x")))
    coords = vector_to_array("pc")
    return placed.select(
        "latent_idx",
        (F.get(coords, F.lit(0)) * signs[0]).alias("map_x"),
        (F.get(coords, F.lit(1)) * signs[1]).alias("map_y"),
    )


def _mean(vec: DataFrame, d: int) -> list[float]:
    rows = vec.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()
    means = [0.0] * d
    for row in rows:
        means[row["i"]] = row["m"]
    return means
