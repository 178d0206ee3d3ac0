"""Slide-level logistic probe: label matching, features, MLlib fit, metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake.functions import ids
from latentlake.operators.filters import binary_label
from latentlake.runtime import attach_small, settle


def label_keys(labels: DataFrame, ordinal: str = "ord") -> DataFrame:
    """``(kind, key, y)`` lookup of every name a label row answers to; later rows overwrite."""
    parsed = labels.withColumn("y", binary_label("label")).where("y is not null")
    parsed = parsed.withColumn("sid", F.trim(F.coalesce("slide_id", F.lit("")))).withColumn("n", ids.name_ids("sid"))
    named = F.col("sid") != ""
    # `turn` orders the writes of one label row: own case first, parsed case after it
    keys = F.array(
        F.struct(F.lit("case").alias("kind"), F.nullif(F.upper(F.trim("case_id")), F.lit("")).alias("key"), F.lit(0).alias("turn")),
        F.struct(F.lit("raw").alias("kind"), F.when(named, F.col("n.raw")).alias("key"), F.lit(1).alias("turn")),
        F.struct(F.lit("raw").alias("kind"), F.when(named, F.col("n.core")).alias("key"), F.lit(2).alias("turn")),
        F.struct(F.lit("slide").alias("kind"), F.when(named, F.col("n.slide_barcode")).alias("key"), F.lit(3).alias("turn")),
        F.struct(F.lit("case").alias("kind"), F.when(named, F.col("n.case_id")).alias("key"), F.lit(4).alias("turn")),
    )
    long = parsed.select("y", F.col(ordinal).alias("ord"), F.inline(keys)).where("key is not null")
    return long.groupBy("kind", "key").agg(F.max_by("y", F.struct("ord", "turn")).alias("y"))


def match_labels(slides: DataFrame, labels: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Label and match reason per slide: raw stem, core, slide barcode, then case."""
    lookup = settle(label_keys(labels, ordinal))
    out = slides.withColumn("n", ids.name_ids("path"))
    for kind, field, name in (
        ("raw", "raw", "y_raw"),
        ("raw", "core", "y_core"),
        ("slide", "slide_barcode", "y_slide"),
        ("case", "case_id", "y_case"),
    ):
        part = lookup.where(F.col("kind") == kind).select(F.col("key").alias(f"_{name}"), F.col("y").alias(name))
        out = out.join(part, F.col(f"n.{field}") == F.col(f"_{name}"), "left").drop(f"_{name}")
    reason = (
        F.when(F.col("y_raw").isNotNull(), "match_raw")
        .when(F.col("y_core").isNotNull(), "match_core")
        .when(F.col("y_slide").isNotNull(), "match_slide_barcode")
        .when(F.col("y_case").isNotNull(), "match_case_fallback")
        .otherwise("no_match")
    )
    return out.select(
        *slides.columns,
        F.col("n.raw").alias("raw_stem_upper"),
        F.col("n.core").alias("core_upper"),
        F.coalesce("n.case_id", F.lit("")).alias("matched_case_id"),
        F.coalesce("n.slide_barcode", F.lit("")).alias("slide_barcode"),
        reason.alias("match_reason"),
        F.coalesce("y_raw", "y_core", "y_slide", "y_case").alias("y"),
    )


@F.udf(VectorUDT())
def _sparse(size, at, values):
    return SparseVector(size, at, values)


def probe_dataset(partials: DataFrame, counts: DataFrame, matched: DataFrame, latent_dim: int) -> DataFrame:
    """``(slide_key, split, y, phi)`` with phi = mean, max and non-zero fraction blocks (M5), as sparse vectors.

    ``partials`` are the slide partials of the encode kernel (firing latents only) and ``counts`` the tiles per slide, so what is shuffled
    follows the firing latents; a slide without any has an empty vector. One row per slide goes through Python.
    """
    n = F.col("total_tiles")
    # a latent that is silent in some tile has a maximum of zero at least
    peak = F.when(F.col("nz_n") < n, F.greatest("z_max", F.lit(0.0))).otherwise(F.col("z_max"))
    known = matched.where("y is not null").select("slide_key", "split", F.col("y").cast("double").alias("y"))
    known = known.join(counts.where(n > 0), "slide_key")
    fired = partials.join(attach_small(known.select("slide_key", "total_tiles")), "slide_key").select(
        "slide_key", "latent_idx", (F.col("z_sum") / n).alias("z_mean"), peak.alias("z_max"), (F.col("nz_n") / n).alias("z_nzfrac")
    )
    rows = F.sort_array(F.collect_list(F.struct("latent_idx", "z_mean", "z_max", "z_nzfrac")))
    packed = fired.groupBy("slide_key").agg(rows.alias("r"))

    def block(off: int, name: str):
        return F.transform("r", lambda x: F.struct((x["latent_idx"] + off).cast("int").alias("pos"), x[name].alias("v")))

    entries = F.concat(block(0, "z_mean"), block(latent_dim, "z_max"), block(2 * latent_dim, "z_nzfrac"))
    packed = packed.select("slide_key", F.filter(entries, lambda e: e["v"] != 0).alias("e"))
    none = F.array().cast("array<struct<pos:int,v:double>>")
    out = known.join(packed, "slide_key", "left").withColumn("e", F.coalesce("e", none))
    phi = _sparse(F.lit(3 * latent_dim), F.col("e.pos"), F.col("e.v"))
    return out.select("slide_key", "split", "y", phi.alias("phi"))


def standardize(train: DataFrame, col: str = "phi"):
    """Fitted scaler to mean 0 and population deviation 1 (M1); constant columns become 0.

    MLlib divides by the sample deviation; the probe's ``phi`` is rescaled by
    sqrt(n / (n - 1)) through the penalty in fit_probe and through scaled().
    """
    return StandardScaler(withMean=True, withStd=True, inputCol=col, outputCol="x_sample").fit(train)


def scaled(df: DataFrame, scaler, n_train: int) -> DataFrame:
    """Add ``x``: standardised with the population deviation of the training rows."""
    factor = (n_train / (n_train - 1)) ** 0.5 if n_train > 1 else 1.0
    out = scaler.transform(df)
    return out.withColumn(
        "x", array_to_vector(F.transform(vector_to_array("x_sample"), lambda v: v * factor))
    ).drop("x_sample")


def fit_probe(
    train: DataFrame, c: float = 1.0, penalty: str = "l2", max_iter: int = 5000, tol: float = 1e-10, min_slides: int = 10
) -> tuple[object, LogisticRegressionModel, int]:
    """(scaler, model, n_train): class-balanced logistic regression on standardised phi (M1, M2).

    Sample weights are n / (2 n_c), so they sum to n and ``regParam = 1 / (C n)``
    gives the objective  sum w_i loss_i + penalty / C. MLlib stops at a relative
    change of the objective; 1e-6 ends before optimality() holds where features
    are correlated.
    """
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    n = sum(counts.values())
    if n < min_slides:
        raise ValueError(f"too few labelled training slides: {n}")
    if len(counts) < 2:
        raise ValueError("training slides carry one class only")
    scaler = standardize(train)
    weight = F.when(F.col("y") == 1, F.lit(n / (2.0 * counts[1.0]))).otherwise(F.lit(n / (2.0 * counts[0.0])))
    ready = scaled(train, scaler, n).withColumn("w", weight)
    model = LogisticRegression(
        featuresCol="x",
        labelCol="y",
        weightCol="w",
        regParam=1.0 / (c * n),
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    ).fit(ready)
    return scaler, model, n


def _gradient_parts(coef: np.ndarray, intercept: float):
    def work(batches):
        total, bias, n = np.zeros(len(coef)), 0.0, 0
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            error = w * (1 / (1 + np.exp(-(x @ coef + intercept))) - y)
            total += error @ x
            bias += error.sum()
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([bias]), pa.array([n])], ["g", "g0", "n"])

    return work


def optimality(train: DataFrame, fitted: tuple[object, LogisticRegressionModel, int], c: float = 1.0, penalty: str = "l2") -> DataFrame:
    """How far a fit is from its optimum (M2): ``(n, residual, start, n_nonzero)`` from one pass over the training rows.

    ``residual`` is the largest violation of the optimality conditions: the gradient of mean weighted loss plus penalty, for L1 the distance of
    the loss gradient from the penalty's subdifferential; the intercept is not penalised. ``start`` is the same for all coefficients zero.
    """
    scaler, model, n = fitted
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    weight = F.when(F.col("y") == 1, F.lit(n / (2.0 * counts[1.0]))).otherwise(F.lit(n / (2.0 * counts[0.0])))
    rows = scaled(train, scaler, n).select(vector_to_array("x").alias("x"), "y", weight.alias("w"))
    reg, coef = 1.0 / (c * n), model.coefficients.toArray()

    def worst(beta: np.ndarray, intercept: float) -> float:
        parts = rows.mapInArrow(_gradient_parts(beta, intercept), "g array<double>, g0 double, n bigint").collect()  # a row per task
        g = sum(np.array(r["g"]) for r in parts) / n
        if penalty == "l2":
            off = np.abs(g + reg * beta)
        else:
            off = np.where(beta != 0, np.abs(g + reg * np.sign(beta)), np.maximum(np.abs(g) - reg, 0.0))
        return float(max(off.max(), abs(sum(r["g0"] for r in parts)) / n))

    row = (n, worst(coef, float(model.intercept)), worst(np.zeros(len(coef)), 0.0), int(np.count_nonzero(coef)))
    return train.sparkSession.createDataFrame([row], "n bigint, residual double, start double, n_nonzero bigint")


def predict(fitted: tuple[object, LogisticRegressionModel, int], df: DataFrame) -> DataFrame:
    """``prob_pos`` and ``pred`` at threshold 0.5 (M4)."""
    scaler, model, n = fitted
    out = model.transform(scaled(df, scaler, n))
    prob = F.get(vector_to_array("probability"), F.lit(1))
    keep = [c for c in df.columns if c != "phi"]
    return out.withColumn("prob_pos", prob).select(*keep, "prob_pos", (F.col("prob_pos") >= 0.5).cast("int").alias("pred"))


def probe_metrics(preds: DataFrame, by: str = "split") -> DataFrame:
    """Accuracy figures, confusion counts and AUC per split (M3).

    AUC comes from counts per distinct score: the pairs a positive outranks, plus
    half of its ties. Rows with one score are combined before the window.
    """
    y, p = F.col("y"), F.col("pred")
    cell = lambda yy, pp: F.count_if((y == yy) & (p == pp))
    base = preds.groupBy(by).agg(
        F.count("*").alias("n"),
        cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"),
    )
    per_score = preds.groupBy(by, "prob_pos").agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    below = Window.partitionBy(by).orderBy("prob_pos").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(below), F.lit(0))
    wins = per_score.withColumn("wins", F.col("pos") * (lower + F.col("neg") / 2.0))
    area = wins.groupBy(by).agg(F.sum("wins").alias("wins"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    ratio = lambda a, b, empty: F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(empty))
    nan = float("nan")
    recall, specificity = ratio(tp, tp + fn, 0.0), ratio(tn, tn + fp, nan)
    # balanced accuracy averages recall over the classes that occur
    balanced = F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall).otherwise((recall + specificity) / 2)
    return base.join(area, by).select(
        by,
        "n",
        F.when((tp + fn > 0) & (tn + fp > 0), F.try_divide(F.col("wins"), (tp + fn) * (tn + fp)))
        .otherwise(F.lit(nan)).alias("auc"),
        ((tp + tn) / F.col("n")).alias("acc"),
        balanced.alias("balanced_acc"),
        ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        ratio(tp, tp + fp, 0.0).alias("precision"),
        recall.alias("recall"),
        specificity.alias("specificity"),
        "tn", "fp", "fn", "tp",
    )


def probe_coefficients(model: LogisticRegressionModel, spark, positive: str = "HPV+", negative: str = "HPV-") -> DataFrame:
    """Coefficients ranked by magnitude within the mean / max / nzfrac blocks."""
    values = model.coefficients.toArray()
    latent_dim = len(values) // 3
    rows = [(b, j, float(values[i * latent_dim + j])) for i, b in enumerate(("mean", "max", "nzfrac")) for j in range(latent_dim)]
    table = spark.createDataFrame(rows, "block string, latent bigint, coef double")
    order = Window.partitionBy("block").orderBy(F.abs("coef").desc(), "latent")
    sign = F.when(F.col("coef") > 0, positive).when(F.col("coef") < 0, negative).otherwise("0")
    return table.select(
        "block", "latent", "coef", F.abs("coef").alias("abscoef"), sign.alias("direction"),
        F.row_number().over(order).alias("block_rank"),
    )


def top_probe_latents(coefs: DataFrame, k: int = 200) -> DataFrame:
    """Latents by their largest coefficient over the three blocks."""
    of = lambda b: F.max(F.when(F.col("block") == b, F.col("coef"))).alias(f"coef_{b}")
    wide = coefs.groupBy("latent").agg(F.max("abscoef").alias("max_abs"), of("mean"), of("max"), of("nzfrac"))
    return wide.orderBy(F.col("max_abs").desc(), "latent").limit(k)


