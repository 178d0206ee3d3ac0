"""Label cascade, probe data, fit and metrics, decoder map: J8, M1-M6, H17."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog.base import query
from latentlake.catalog.fixtures import VIEWS
from latentlake.catalog.scalars import _BAR, _STEM
from latentlake.operators import encode, latent_map, probe, stats

# Label rows for every labelled document; the slide name comes in four forms.
VIEWS["label_rows"] = (
    "doc_names",
    """
SELECT doc_id AS ord, CASE WHEN doc_id % 5 = 3 THEN '' ELSE ' ' || lower(case_barcode) END AS case_id,
  CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN lower(barcode) || '.uuid' WHEN 2 THEN case_barcode ELSE '' END AS slide_id,
  CASE WHEN doc_id % 17 = 4 THEN 'n/a' WHEN quality = 1 THEN 'hpv+ ' ELSE 'HPV-' END AS label FROM doc_names WHERE quality >= 0""",
)


def label_rows(spark, sf):
    return fx.doc_names(spark, sf).where("quality >= 0").selectExpr(
        "doc_id as ord", "if(doc_id % 5 = 3, '', concat(' ', lower(case_barcode))) as case_id",
        "case doc_id % 4 when 0 then path when 1 then concat(lower(barcode), '.uuid') when 2 then case_barcode else '' end as slide_id",
        "case when doc_id % 17 = 4 then 'n/a' when quality = 1 then 'hpv+ ' else 'HPV-' end as label",
    )


def _parsed(col: str, source: str) -> str:
    stem = _STEM.replace("path", col)
    return f"""(SELECT *, regexp_extract(core, '(TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}})', 1) AS cid, regexp_extract(core, '({_BAR}DX[0-9])', 1) AS bar
  FROM (SELECT *, upper({stem}) AS raw, upper(split_part(split_part({stem}, '_', 1), '.', 1)) AS core FROM {source}))"""


@query(
    "j8_label_cascade",
    needs="doc_names label_rows",
    sql=f"""WITH l AS (SELECT ord, upper(trim(case_id)) AS own, slide_id, raw, core, cid, bar,
  CASE upper(trim(label)) WHEN 'HPV+' THEN 1 WHEN 'HPV-' THEN 0 END AS y FROM {_parsed('slide_id', 'label_rows')} WHERE upper(trim(label)) IN ('HPV+', 'HPV-')),
by_raw AS (SELECT k, arg_max(y, (ord, t)) AS y FROM (SELECT raw AS k, y, ord, 1 AS t FROM l WHERE slide_id <> '' UNION ALL SELECT core, y, ord, 2 FROM l WHERE slide_id <> '') GROUP BY 1),
by_slide AS (SELECT bar AS k, arg_max(y, ord) AS y FROM l WHERE bar <> '' GROUP BY 1),
by_case AS (SELECT k, arg_max(y, (ord, t)) AS y FROM (SELECT own AS k, y, ord, 1 AS t FROM l WHERE own <> '' UNION ALL SELECT cid, y, ord, 2 FROM l WHERE cid <> '') GROUP BY 1)
SELECT d.doc_id, d.raw AS raw_stem_upper, d.core AS core_upper, d.cid AS matched_case_id, d.bar AS slide_barcode,
  CASE WHEN a.y IS NOT NULL THEN 'match_raw' WHEN b.y IS NOT NULL THEN 'match_core' WHEN c.y IS NOT NULL THEN 'match_slide_barcode'
    WHEN e.y IS NOT NULL THEN 'match_case_fallback' ELSE 'no_match' END AS match_reason, coalesce(a.y, b.y, c.y, e.y, -1) AS y
FROM {_parsed('path', 'doc_names')} d LEFT JOIN by_raw a ON a.k = d.raw LEFT JOIN by_raw b ON b.k = d.core
LEFT JOIN by_slide c ON c.k = d.bar AND d.bar <> '' LEFT JOIN by_case e ON e.k = d.cid AND d.cid <> ''""",
)
def j8(spark, sf):
    matched = probe.match_labels(fx.doc_names(spark, sf).select("doc_id", "path"), label_rows(spark, sf))
    return matched.drop("path").fillna(-1, ["y"])


# Slide labels of the dense fixture: does the slide's mean tile label exceed 4.5?
VIEWS["dense_labels"] = (
    "tiles",
    "SELECT slide_key, split, CASE WHEN avg(label) > 4.5 THEN 1.0 ELSE 0.0 END AS y FROM tiles GROUP BY 1, 2",
)
VIEWS["phi"] = (
    "pre",
    """
SELECT slide_key, split, latent_idx + o AS pos, CASE o WHEN 0 THEN m WHEN 40 THEN x ELSE f END AS v FROM (
  SELECT slide_key, split, latent_idx, avg(greatest(a, 0)) AS m, max(greatest(a, 0)) AS x, avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END) AS f
  FROM pre GROUP BY 1, 2, 3) CROSS JOIN (VALUES (0), (40), (80)) t(o)""",
)


def dense_probe_inputs(spark, sf):
    """Slides with paths, and one label row per slide."""
    slides = fx.dense_slides(spark, sf).select("slide_key", F.col("feature_path").alias("path"), "split")
    labels = fx.tiles(spark, sf).groupBy("slide_key", "case_id").agg(F.avg("label").alias("m")).selectExpr(
        "case_id", "slide_key as slide_id", "if(m > 4.5, 'HPV+', 'HPV-') as label", "slide_key as ord"
    )
    return slides, labels


def _dataset(spark, sf):
    tiles, model = fx.tiles(spark, sf), fx.model(spark, sf)
    slides, labels = dense_probe_inputs(spark, sf)
    return probe.probe_dataset(encode.encode_slide_stats(tiles, model), stats.count_tiles(tiles), probe.match_labels(slides, labels), fx.LATENTS)


@query(
    "m5_probe_dataset",
    needs="phi dense_labels",
    d="v",
    sql="SELECT slide_key, split, y, pos, v FROM phi JOIN dense_labels USING (slide_key, split)",
)
def m5(spark, sf):
    out = _dataset(spark, sf)
    return out.select("slide_key", "split", "y", F.posexplode(vector_to_array("phi")).alias("pos", "v"))


@query(
    "m1_standardise",
    needs="phi",
    d="x",
    sql="""SELECT slide_key, pos, CASE WHEN max(v) OVER w = min(v) OVER w THEN 0 ELSE (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS x
FROM phi WHERE split = 'train' WINDOW w AS (PARTITION BY pos)""",
)
def m1(spark, sf):
    train = _dataset(spark, sf).where("split = 'train'")
    out = probe.scaled(train, probe.standardize(train), train.count())
    return out.select("slide_key", F.posexplode(vector_to_array("x")).alias("pos", "x"))


def _fit(spark, sf, penalty="l2"):
    data = _dataset(spark, sf)
    return data, probe.fit_probe(data.where("split = 'train'"), c=1.0, penalty=penalty)


@query("m2_probe_l1", d="coef abscoef")
def m2(spark, sf):
    return probe.probe_coefficients(_fit(spark, sf, "l1")[1][1], spark)


for _penalty in ("l1", "l2"):

    def _certified(spark, sf, penalty=_penalty):
        data, fitted = _fit(spark, sf, penalty)
        row = probe.optimality(data.where("split = 'train'"), fitted, 1.0, penalty)
        return row.select(F.col("n").alias("n_train"), (F.col("residual") <= 1e-3 * F.col("start")).alias("optimal"))

    query(
        f"m2_optimality_{_penalty}", needs="phi dense_labels",
        sql="SELECT count(DISTINCT slide_key) AS n_train, true AS optimal FROM phi JOIN dense_labels USING (slide_key, split) WHERE split = 'train'",
    )(_certified)


@query("m4_predictions", d="prob_pos")
def m4(spark, sf):
    data, fitted = _fit(spark, sf)
    return probe.predict(fitted, data)


@query("h17_probe_top_latents", d="max_abs coef_mean coef_max coef_nzfrac")
def h17(spark, sf):
    return probe.top_probe_latents(probe.probe_coefficients(_fit(spark, sf)[1][1], spark))


@query(
    "m3_probe_metrics",
    needs="doc_names",
    d="auc acc balanced_acc f1 precision recall specificity",
    sql="""WITH p AS (SELECT cohort AS split, quality AS y, (CAST('0x' || substr(md5(path), 1, 8) AS BIGINT) % 41) / 40.0 AS p FROM doc_names WHERE quality >= 0),
c AS (SELECT split, count(*) AS n, count_if(y = 1 AND p >= 0.5) AS tp, count_if(y = 0 AND p < 0.5) AS tn,
  count_if(y = 0 AND p >= 0.5) AS fp, count_if(y = 1 AND p < 0.5) AS fn FROM p GROUP BY 1),
a AS (SELECT x.split, avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0.0 END) AS auc
  FROM p x JOIN p z ON x.split = z.split AND x.y = 1 AND z.y = 0 GROUP BY 1)
SELECT split, n, coalesce(auc, 'nan') AS auc, (tp + tn) / n AS acc,
  CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS balanced_acc,
  CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tn + fp = 0 THEN 'nan' ELSE tn / (tn + fp) END AS specificity,
  tn, fp, fn, tp FROM c LEFT JOIN a USING (split)""",
)
def m3(spark, sf):
    preds = fx.doc_names(spark, sf).where("quality >= 0").selectExpr(
        "cohort as split", "quality as y",
        "cast(conv(substr(md5(path), 1, 8), 16, 10) as bigint) % 41 / 40 as prob_pos",
    )
    return probe.probe_metrics(preds.withColumn("pred", (F.col("prob_pos") >= 0.5).cast("int")))


@query("m6_latent_map", d="map_x map_y")
def m6(spark, sf):
    weights = fx.encoder(spark, sf)
    alive = encode.encode_stats(fx.tiles(spark, sf), fx.model(spark, sf)).where("z_max > 0")
    return latent_map.latent_map(weights, alive)
