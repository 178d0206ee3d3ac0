"""Identifier and vector scalars: B1-B15, V1-V12."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog.base import query
from latentlake.functions import ids, vectors
from latentlake.operators import encode

_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_STEM = f"regexp_replace({_NAME}, '^(.+)\\.[^.]+$', '\\1')"
_BAR = "TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}-[0-9]{2}[A-Z]-[0-9]{2}-"


def _slide_sql(col: str, tail: str) -> str:
    stem = _STEM.replace("path", col)
    return (
        f"upper(coalesce(nullif(regexp_extract({col}, '({_BAR}{tail})', 1, 'i'), ''), split_part({stem}, '.', 1)))"
    )


def _case_sql(col: str) -> str:
    return f"upper(coalesce(nullif(regexp_extract({col}, '(TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}})', 1, 'i'), ''), {col}))"


@query(
    "b1_slide_id",
    needs="doc_names",
    sql=f"""SELECT doc_id, {_slide_sql('path', 'DX[0-9A-Z]+')} AS slide_id, {_slide_sql('path', 'DX[0-9]+')} AS slide_id_number,
  {_slide_sql('path', 'DX[0-9]')} AS slide_id_digit FROM doc_names""",
)
def b1(spark, sf):
    return fx.doc_names(spark, sf).select(
        "doc_id",
        ids.slide_id("path").alias("slide_id"),
        ids.slide_id("path", ids.DX_NUMBER).alias("slide_id_number"),
        ids.slide_id("path", ids.DX_DIGIT).alias("slide_id_digit"),
    )


@query("b2_case_id", needs="doc_names", sql=f"SELECT doc_id, {_case_sql('path')} AS case_id FROM doc_names")
def b2(spark, sf):
    return fx.doc_names(spark, sf).select("doc_id", ids.case_id("path").alias("case_id"))


@query(
    "b3_cohort_from_path",
    needs="doc_names",
    sql="""SELECT doc_id, coalesce(regexp_replace(list_filter(string_split(upper(path), '/'),
  lambda x : x LIKE 'TCGA-_%')[1], '^TCGA-', ''), '') AS cohort FROM doc_names""",
)
def b3(spark, sf):
    cohort = F.coalesce(ids.cohort_from_path("path"), F.lit(""))
    return fx.doc_names(spark, sf).select("doc_id", cohort.alias("cohort"))


@query(
    "b4_normalise",
    needs="doc_names",
    sql="""SELECT doc_id, CASE WHEN quality < 0 THEN 'TCGA' ELSE 'PROJ' END AS project,
  cohort, (CASE WHEN quality < 0 THEN 'TCGA' ELSE 'PROJ' END) || '-' || cohort AS dir FROM doc_names""",
)
def b4(spark, sf):
    raw_project = F.expr("if(quality < 0, '  ', ' proj ')")
    raw_cohort = F.expr("concat(if(toxic = 1, ' tcga-', ' '), lower(cohort), ' ')")
    return fx.doc_names(spark, sf).select(
        "doc_id",
        ids.norm_project(raw_project).alias("project"),
        ids.norm_cohort(raw_cohort).alias("cohort"),
        ids.cohort_dir(raw_project, raw_cohort).alias("dir"),
    )


@query(
    "b5_canonical_encoder",
    needs="doc_names",
    sql="""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'uni2' WHEN 1 THEN 'seal' WHEN 2 THEN 'virchow2' ELSE 'gigapath' END AS encoder,
  CASE WHEN quality < 0 THEN '' ELSE encoder END AS known FROM doc_names""",
)
def b5(spark, sf):
    alias = F.expr(
        "case doc_id % 4 when 0 then ' UNI2h' when 1 then 'features_seal' when 2 then 'Virchow2' else 'features_gigapath' end"
    )
    loose = F.expr("if(quality < 0, 'resnet', concat('features_', encoder))")
    return fx.doc_names(spark, sf).select(
        "doc_id",
        ids.canonical_encoder(alias).alias("encoder"),
        F.coalesce(ids.canonical_encoder(loose, strict=False), F.lit("")).alias("known"),
    )


@query(
    "b7_project_key",
    needs="doc_names",
    sql=f"""SELECT doc_id, coalesce(list_filter(string_split(upper(path), '/'), lambda x : regexp_matches(x, '^TCGA-[A-Z0-9]+$'))[1],
  CASE WHEN upper({_STEM}) LIKE 'TCGA-%' THEN 'TCGA' ELSE 'UNKNOWN' END) AS project FROM doc_names""",
)
def b7(spark, sf):
    return fx.doc_names(spark, sf).select("doc_id", ids.project_key("path").alias("project"))


@query(
    "b8_name_ids",
    needs="doc_names",
    sql=f"""WITH n AS (SELECT doc_id, upper({_STEM}) AS raw, upper(split_part(split_part({_STEM}, '_', 1), '.', 1)) AS core FROM doc_names)
SELECT doc_id, regexp_extract(core, '(TCGA-[A-Z0-9]{{2}}-[A-Z0-9]{{4}})', 1) AS case_id,
  regexp_extract(core, '({_BAR}DX[0-9])', 1) AS slide_barcode, raw, core FROM n""",
)
def b8(spark, sf):
    out = fx.doc_names(spark, sf).select("doc_id", ids.name_ids("path").alias("n")).select("doc_id", "n.*")
    return out.fillna("", ["case_id", "slide_barcode"])


@query(
    "b9_candidate_names",
    needs="doc_names",
    sql=f"""WITH n AS (SELECT doc_id, {_NAME} AS name, {_STEM} AS stem FROM doc_names),
p AS (SELECT *, regexp_extract(stem, '^(TCGA-[A-Za-z0-9]{{2}}-[A-Za-z0-9]{{4}}-[0-9]{{2}}[A-Z]-[0-9]{{2}}-DX[0-9A-Z]+)', 1) AS bar FROM n),
c AS (SELECT doc_id, unnest([
  {{'o': 1, 'v': name}},
  {{'o': 2, 'v': CASE WHEN bar <> '' THEN bar || '.h5' END}},
  {{'o': 3, 'v': CASE WHEN regexp_matches(bar, '-DX[A-Z]$') THEN left(bar, len(bar) - 1) || CAST(ascii(right(bar, 1)) - 64 AS VARCHAR) || '.h5' END}},
  {{'o': 4, 'v': CASE WHEN contains(stem, '.') THEN split_part(stem, '.', 1) || '.h5' END}}]) AS e, name FROM p),
f AS (SELECT doc_id, e.v AS v, min(e.o) AS o FROM c WHERE e.v IS NOT NULL AND (lower(name) LIKE '%.h5' OR e.o = 1) GROUP BY ALL)
SELECT doc_id, string_agg(v, '|' ORDER BY o) AS names FROM f GROUP BY 1""",
)
def b9(spark, sf):
    return fx.doc_names(spark, sf).select("doc_id", F.concat_ws("|", ids.candidate_names("path")).alias("names"))


_ENC_RANK = """CASE WHEN e = 'gigapath' THEN 0
  WHEN e = 'seal' AND (contains(p, 'features_seal') OR contains(p, '/seal/')) THEN 1
  WHEN e = 'uni2' AND contains(p, 'uni2') THEN 2
  WHEN e = 'virchow2' AND contains(p, 'virchow2') THEN 3
  ELSE 4 + o END"""


@query(
    "b10_candidate_encoders",
    needs="doc_names",
    sql=f"""SELECT doc_id, string_agg(e, '|' ORDER BY r) AS encoders FROM (
  SELECT doc_id, e, {_ENC_RANK} AS r FROM (SELECT doc_id, lower(path) AS p FROM doc_names)
  CROSS JOIN (VALUES ('uni2', 0), ('seal', 1), ('gigapath', 2), ('virchow2', 3)) v(e, o)) GROUP BY 1""",
)
def b10(spark, sf):
    names = ids.candidate_encoders("path", preferred="gigapath")
    return fx.doc_names(spark, sf).select("doc_id", F.concat_ws("|", names).alias("encoders"))


@query(
    "b11_feature_relpath",
    needs="doc_names",
    sql=f"""SELECT doc_id, CASE WHEN path LIKE '/old/%' THEN substr(path, 6)
  WHEN contains(path, '/wsi_features/') THEN substr(path, strpos(path, '/wsi_features/') + 1) ELSE {_NAME} END AS relpath FROM doc_names""",
)
def b11(spark, sf):
    return fx.doc_names(spark, sf).select("doc_id", ids.feature_relpath("path", "/old").alias("relpath"))


@query(
    "b12_latent_group",
    needs="sparse_stats parents",
    sql="""SELECT s.latent_idx, coalesce('parent_' || parent, 'selected') AS latent_group
FROM sparse_stats s LEFT JOIN parents p USING (latent_idx)""",
)
def b12(spark, sf):
    parents = encode.parent_assignment(encode.coefficients(fx.level2(spark, sf)))
    return ids.latent_group(fx.sparse_stats(spark, sf).select("latent_idx"), parents)


@query(
    "b13_path_suffix",
    needs="doc_names",
    sql=f"SELECT doc_id, lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)) AS suffix FROM doc_names",
)
def b13(spark, sf):
    return fx.doc_names(spark, sf).select("doc_id", ids.path_suffix("path").alias("suffix"))


@query(
    "b15_stable_hash",
    needs="doc_names",
    sql="SELECT doc_id, CAST('0x' || substr(md5(path), 1, 8) AS BIGINT) AS hash FROM doc_names",
)
def b15(spark, sf):
    return fx.doc_names(spark, sf).select("doc_id", ids.stable_hash32("path").alias("hash"))


# --- vectors -----------------------------------------------------------------------------

_MOMENTS = """WITH m AS (SELECT *, avg(x) OVER w AS mu, var_pop(x) OVER w AS v, sqrt(sum(x * x) OVER w) AS l2 FROM tile_dims
  WINDOW w AS (PARTITION BY slide_key, tile_index))"""


def _normalized(how: str):
    def build(spark, sf):
        out = vectors.normalize(fx.tiles(spark, sf), how)
        return out.select("slide_key", "tile_index", F.posexplode("features").alias("dim", "x"))

    return build


for _id, _how, _formula in (
    ("v1_l2_normalise", "l2", "x / (l2 + 1e-8)"),
    ("v2_layer_norm", "layernorm", "(x - mu) / (sqrt(v) + 1e-8)"),
    ("v3_input_norm", "input_ln", "(x - mu) / sqrt(v + 1e-5)"),
):
    query(_id, needs="tile_dims", d="x", sql=f"{_MOMENTS} SELECT slide_key, tile_index, dim, {_formula} AS x FROM m")(
        _normalized(_how)
    )


@query("v4_encode_fused", needs="dense", d="z", sql="SELECT slide_key, tile_index, coord_x, coord_y, latent_idx, z FROM dense")
def v4(spark, sf):
    return encode.encode_hits(fx.tiles(spark, sf), fx.model(spark, sf))


@query("v4_encode_expression", needs="pre", d="z", sql="SELECT slide_key, tile_index, coord_x, coord_y, latent_idx, greatest(a, 0) AS z FROM pre")
def v4_sql(spark, sf):
    return encode.encode_sql(fx.tiles(spark, sf), fx.encoder(spark, sf))


@query(
    "v4_encode_blocked",
    needs="dense",
    d="z",
    sql="SELECT slide_key, tile_index, coord_x, coord_y, latent_idx, z FROM dense",
)
def v4_blocked(spark, sf):
    """Weights split into blocks of 16 latents, as a model above the broadcast bound is."""
    return encode.encode_hits(fx.tiles(spark, sf), fx.model(spark, sf, block_bytes=16 * fx.D_IN * 8))


@query(
    "v4_encode_input_norm",
    needs="tile_dims model_dims",
    d="z",
    sql=f"""{_MOMENTS},
n AS (SELECT slide_key, tile_index, dim, (x - mu) / sqrt(v + 1e-5) AS x FROM m),
a AS (SELECT slide_key, tile_index, latent_idx, sum(x * w) AS s FROM n JOIN model_dims USING (dim) GROUP BY ALL)
SELECT slide_key, tile_index, latent_idx, s + (-0.01 * (latent_idx % 3)) AS z FROM a WHERE s + (-0.01 * (latent_idx % 3)) > 0""",
)
def v4_norm(spark, sf):
    hits = encode.encode_hits(fx.tiles(spark, sf), fx.model(spark, sf, input_norm=True))
    return hits.select("slide_key", "tile_index", "latent_idx", "z")


def _topk_sql(score: str, value: str) -> str:
    return f"""SELECT slide_key, tile_index, latent_idx, {value} AS z FROM (
  SELECT *, row_number() OVER (PARTITION BY slide_key, tile_index ORDER BY {score} DESC, latent_idx) AS rn FROM pre) WHERE rn <= 5"""


def _topk(**rule):
    def build(spark, sf):
        hits = encode.encode_hits(fx.tiles(spark, sf), fx.model(spark, sf, kind="topk", k=5, **rule))
        return hits.select("slide_key", "tile_index", "latent_idx", "z")

    return build


query("v5_topk_value", needs="pre", d="z", sql=_topk_sql("a", "a"))(_topk())
query("v5_topk_magnitude", needs="pre", d="z", sql=_topk_sql("abs(a)", "a"))(_topk(mode="magnitude"))
query("v5_topk_nonneg", needs="pre", d="z", sql=_topk_sql("greatest(a, 0)", "greatest(a, 0)"))(_topk(nonneg=True))
query("v5_topk_blocked", needs="pre", d="z", sql=_topk_sql("abs(a)", "a"))(
    _topk(mode="magnitude", block_bytes=16 * fx.D_IN * 8)
)


@query("v5_topk_table", needs="pre", d="z", sql=_topk_sql("abs(a)", "a"))
def v5_table(spark, sf):
    pre = encode.pre_activations(fx.tiles(spark, sf), fx.model(spark, sf))
    return encode.topk(pre, 5, mode="magnitude").select("slide_key", "tile_index", "latent_idx", "z")


def _batch_sql(score: str) -> str:
    return f"""WITH p AS (SELECT *, tile_index // 8 AS chunk FROM pre),
r AS (SELECT *, row_number() OVER (PARTITION BY slide_key, chunk ORDER BY {score} DESC, latent_idx, tile_index) AS rn,
  count(DISTINCT tile_index) OVER (PARTITION BY slide_key, chunk) AS b FROM p)
SELECT slide_key, tile_index, latent_idx, a AS z FROM r WHERE rn <= 3 * b"""


for _mode, _score in (("value", "a"), ("magnitude", "abs(a)")):

    def _batch(spark, sf, mode=_mode):
        model = fx.model(spark, sf, kind="batch_topk", k=3, chunk_tiles=8, mode=mode)
        return encode.encode_hits(fx.tiles(spark, sf), model).select("slide_key", "tile_index", "latent_idx", "z")

    query(f"v6_batch_topk_{_mode}", needs="pre", d="z", sql=_batch_sql(_score))(_batch)


def _batch_blocked(spark, sf):
    model = fx.model(spark, sf, kind="batch_topk", k=3, chunk_tiles=8, mode="magnitude", block_bytes=7 * fx.D_IN * 8)
    return encode.encode_hits(fx.tiles(spark, sf), model).select("slide_key", "tile_index", "latent_idx", "z")


query("v6_batch_topk_blocked", needs="pre", d="z", sql=_batch_sql("abs(a)"))(_batch_blocked)


@query("v7_hit_flatten", needs="pre", d="z", sql=_topk_sql("a", "a"))
def v7(spark, sf):
    hits = encode.encode_hits(fx.tiles(spark, sf), fx.model(spark, sf, kind="topk", k=5))
    packed = hits.groupBy("slide_key", "tile_index").agg(F.collect_list(F.struct("latent_idx", "z")).alias("h"))
    arrays = packed.select(
        "slide_key", "tile_index",
        F.transform("h", lambda r: r["latent_idx"]).alias("topk_idx"), F.transform("h", lambda r: r["z"]).alias("topk_val"),
    )
    return encode.hits_from_arrays(arrays)


_DECODE_SQL = """SELECT slide_key, tile_index, dim, s + 0.01 AS x_hat FROM (
  SELECT d.slide_key, d.tile_index, m.dim, sum(d.z * m.w) AS s FROM dense d JOIN model_dims m USING (latent_idx) GROUP BY ALL)"""


@query("v8_decode_fused", needs="dense model_dims", d="x_hat", sql=_DECODE_SQL)
def v8(spark, sf):
    recon = encode.reconstruct(fx.tiles(spark, sf), fx.model(spark, sf), b_dec=(0.01,) * fx.D_IN)
    fired = recon.where("z_l1 > 0")
    return fired.select("slide_key", "tile_index", F.posexplode("x_hat").alias("dim", "x_hat"))


@query("v8_decode_blocked", needs="dense model_dims", d="x_hat", sql=_DECODE_SQL)
def v8_blocked(spark, sf):
    model = fx.model(spark, sf, block_bytes=16 * fx.D_IN * 8)
    recon = encode.reconstruct(fx.tiles(spark, sf), model, fx.encoder(spark, sf), b_dec=(0.01,) * fx.D_IN)
    fired = recon.where("z_l1 > 0")
    return fired.select("slide_key", "tile_index", F.posexplode("x_hat").alias("dim", "x_hat"))


def _decode_hits_sql(hits: str) -> str:
    """Every tile's decoded vector: tiles without a hit decode to the bias."""
    return f"""WITH h AS ({hits}),
s AS (SELECT h.slide_key, h.tile_index, m.dim, sum(h.z * m.w) AS s FROM h JOIN model_dims m USING (latent_idx) GROUP BY ALL)
SELECT t.slide_key, t.tile_index, t.dim, coalesce(s.s, 0) + 0.01 AS x_hat
FROM tile_dims t LEFT JOIN s ON s.slide_key = t.slide_key AND s.tile_index = t.tile_index AND s.dim = t.dim"""


def _decoded(**rule):
    def build(spark, sf):
        recon = encode.reconstruct(fx.tiles(spark, sf), fx.model(spark, sf, **rule), fx.encoder(spark, sf), b_dec=(0.01,) * fx.D_IN)
        return recon.select("slide_key", "tile_index", F.posexplode("x_hat").alias("dim", "x_hat"))

    return build


for _name, _hits, _rule in (
    ("batch_topk", _batch_sql("a"), {"kind": "batch_topk", "k": 3, "chunk_tiles": 8}),
    ("batch_topk_blocked", _batch_sql("abs(a)"), {"kind": "batch_topk", "k": 3, "chunk_tiles": 8, "mode": "magnitude", "block_bytes": 7 * fx.D_IN * 8}),
    ("topk_blocked", _topk_sql("a", "a"), {"kind": "topk", "k": 5, "block_bytes": 16 * fx.D_IN * 8}),
):
    query(f"v8_decode_{_name}", needs="pre tile_dims model_dims", d="x_hat", sql=_decode_hits_sql(_hits))(_decoded(**_rule))


@query("v8_decode_table", needs="dense model_dims", d="x_hat", sql=_DECODE_SQL)
def v8_table(spark, sf):
    weights = fx.encoder(spark, sf)
    bias = spark.range(fx.D_IN).selectExpr("cast(id as int) as dim", "0.01D as b")
    return encode.decode(encode.encode_hits(fx.tiles(spark, sf), fx.model(spark, sf)), weights, bias)


@query("v9_decoder_dictionary", needs="model_dims", d="weight", sql="SELECT dim, latent_idx, w AS weight FROM model_dims")
def v9(spark, sf):
    return encode.decoder_dictionary(fx.encoder(spark, sf))


_COEFF = {
    "raw": ("raw", {}),
    "softplus": ("greatest(raw, 0) + ln(1 + exp(-abs(raw)))", {"nonneg": True}),
    "softmax": ("exp(raw) / sum(exp(raw)) OVER (PARTITION BY latent_idx)", {"simplex": True}),
}
for _rule, (_expr, _kw) in _COEFF.items():

    def _coeff(spark, sf, kw=_kw):
        return encode.coefficients(fx.level2(spark, sf), **kw).select("latent_idx", F.posexplode("coeff").alias("parent", "coeff"))

    query(
        f"v10_coefficients_{_rule}", needs="level2_dims", d="coeff",
        sql=f"SELECT latent_idx, parent, {_expr} AS coeff FROM level2_dims",
    )(_coeff)


@query("v11_parent_assignment", needs="parents", sql="SELECT latent_idx, parent FROM parents")
def v11(spark, sf):
    return encode.parent_assignment(encode.coefficients(fx.level2(spark, sf), simplex=True))


@query(
    "v12_margin",
    needs="pre",
    d="margin",
    sql="""SELECT slide_key, tile_index, latent_idx, margin FROM (
  SELECT p.slide_key, p.tile_index, p.latent_idx, max(p.a) AS a, max(greatest(p.a, 0)) - max(greatest(q.a, 0)) AS margin
  FROM pre p JOIN pre q ON p.slide_key = q.slide_key AND p.tile_index = q.tile_index AND p.latent_idx <> q.latent_idx
  GROUP BY p.slide_key, p.tile_index, p.latent_idx) WHERE a > 0""",
)
def v12(spark, sf):
    hits = encode.encode_hits(fx.tiles(spark, sf), fx.model(spark, sf))
    return encode.margin(hits, fx.LATENTS).select("slide_key", "tile_index", "latent_idx", "margin")
