"""Sampling and grid pooling: D1-D7, E1-E6."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog import fixtures as fx
from latentlake.catalog.base import query
from latentlake.operators import pooling, sampling


@query(
    "d1_cap_tiles",
    needs="sparse_tiles",
    sql="""SELECT slide_key, tile_index FROM (SELECT *, row_number() OVER (PARTITION BY slide_key
  ORDER BY md5(concat_ws('|', '7', 'pass1', slide_key, tile_index)), tile_index) AS rn FROM sparse_tiles) WHERE rn <= 50""",
)
def d1(spark, sf):
    return sampling.cap_tiles(fx.sparse_keys(spark, sf), 50, 7, "pass1")


@query(
    "d2_cap_slides",
    needs="slides",
    sql="""SELECT slide_key, project, md5(concat_ws('|', '3', 'out', slide_key)) AS shuffle_key FROM (
  SELECT slide_key, cohort AS project, row_number() OVER (PARTITION BY cohort
    ORDER BY md5(concat_ws('|', '3', cohort, slide_key)), slide_key) AS rn FROM slides) WHERE rn <= 5""",
)
def d2(spark, sf):
    slides = fx.slides(spark, sf).select("slide_key", F.col("cohort").alias("project"))
    return sampling.cap_slides(slides, 5, 3)


_POS = """p AS (SELECT slide_key, tile_index, row_number() OVER (PARTITION BY slide_key ORDER BY tile_index) - 1 AS pos,
  count(*) OVER (PARTITION BY slide_key) AS n FROM sparse_tiles)"""


def _hash(modulus: str, *parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT) % ({modulus}))"


@query(
    "d3_slice_sample",
    needs="sparse_tiles",
    sql=f"""WITH {_POS}, s AS (SELECT *, {_hash('n - 40 + 1', "'5'", "'slice'", 'slide_key')} AS start FROM p WHERE n >= 40)
SELECT slide_key, tile_index, tile_index AS draw FROM s WHERE pos BETWEEN start AND start + 39""",
)
def d3(spark, sf):
    return sampling.sample_slice(fx.sparse_keys(spark, sf), 40, 5)


@query(
    "d4_multislice_sample",
    needs="sparse_tiles",
    sql=f"""WITH {_POS}, c AS (SELECT p.*, range AS chunk, 10 + CASE WHEN range < 2 THEN 1 ELSE 0 END AS size FROM p CROSS JOIN range(4)),
s AS (SELECT *, {_hash('n - size + 1', "'5'", "'multislice'", 'slide_key', 'chunk')} AS start FROM c WHERE n >= size)
SELECT slide_key, tile_index, chunk, tile_index AS draw FROM s WHERE pos BETWEEN start AND start + size - 1""",
)
def d4(spark, sf):
    return sampling.sample_multislice(fx.sparse_keys(spark, sf), 42, 4, 5)


@query(
    "d5_indexed_sample",
    needs="sparse_tiles",
    sql=f"""WITH {_POS}, r AS (SELECT *, row_number() OVER (PARTITION BY slide_key
  ORDER BY md5(concat_ws('|', '5', 'indexed', slide_key, tile_index)), tile_index) AS rn FROM p WHERE n >= 64)
SELECT slide_key, tile_index, tile_index AS draw FROM r WHERE rn <= 64""",
)
def d5(spark, sf):
    return sampling.sample_indexed(fx.sparse_keys(spark, sf), 64, 5)


@query(
    "d5_indexed_with_replacement",
    needs="tiles",
    sql=f"""WITH {_POS.replace('sparse_tiles', 'tiles')}, s AS (SELECT DISTINCT slide_key, n FROM p WHERE n < 50),
d AS (SELECT slide_key, range AS draw, {_hash('n', "'9'", "'replace'", 'slide_key', 'range')} AS pos FROM s CROSS JOIN range(50)),
r AS (SELECT *, row_number() OVER (PARTITION BY slide_key
  ORDER BY md5(concat_ws('|', '9', 'indexed', slide_key, tile_index)), tile_index) AS rn FROM p WHERE n >= 50)
SELECT slide_key, tile_index, draw FROM d JOIN p USING (slide_key, pos)
UNION ALL SELECT slide_key, tile_index, tile_index FROM r WHERE rn <= 50""",
)
def d5_replace(spark, sf):
    out = sampling.sample_indexed(fx.tiles(spark, sf).select("slide_key", "tile_index"), 50, 9)
    return out.select("slide_key", "tile_index", "draw")


@query(
    "d5_short_without_replacement",
    needs="tiles",
    sql="SELECT slide_key, tile_index, tile_index AS draw FROM tiles",
)
def d5_short(spark, sf):
    return sampling.sample_indexed(fx.tiles(spark, sf).select("slide_key", "tile_index"), 50, 9, replace=False)


@query(
    "d7_uniform_sample",
    needs="acts",
    d="z",
    sql="""SELECT slide_key, tile_index, latent_idx, z FROM acts
ORDER BY md5(concat_ws('|', '1337', 'sample', slide_key, tile_index, latent_idx)), slide_key, tile_index, latent_idx LIMIT 5000""",
)
def d7(spark, sf):
    acts = fx.acts(spark, sf).select("slide_key", "tile_index", "latent_idx", "z")
    return sampling.uniform_sample(acts, 5000, 1337, ["slide_key", "tile_index", "latent_idx"])


# --- pooling -----------------------------------------------------------------------------

_STEPS = """sx AS (SELECT slide_key, min(gap) AS step_x, min(v) AS x0 FROM (SELECT slide_key, coord_x AS v,
  coord_x - lag(coord_x) OVER (PARTITION BY slide_key ORDER BY coord_x) AS gap FROM (SELECT DISTINCT slide_key, coord_x FROM grid_tiles)) GROUP BY 1),
sy AS (SELECT slide_key, min(gap) AS step_y, min(v) AS y0 FROM (SELECT slide_key, coord_y AS v,
  coord_y - lag(coord_y) OVER (PARTITION BY slide_key ORDER BY coord_y) AS gap FROM (SELECT DISTINCT slide_key, coord_y FROM grid_tiles)) GROUP BY 1),
steps AS (SELECT * FROM sx JOIN sy USING (slide_key))"""
_REJECT = f"""{_STEPS},
q AS (SELECT g.*, (coord_x - x0) // step_x AS qx, (coord_y - y0) // step_y AS qy,
  (coord_x - x0) % step_x <> 0 OR (coord_y - y0) % step_y <> 0 AS off FROM grid_tiles g JOIN steps USING (slide_key)),
bad AS (SELECT slide_key, CASE WHEN bool_or(off) THEN 'inconsistent_spacing' ELSE 'duplicate_cell' END AS reason FROM (
  SELECT slide_key, off, count(*) OVER (PARTITION BY slide_key, qx, qy) AS c FROM q) GROUP BY 1 HAVING bool_or(off) OR max(c) > 1),
cell AS (SELECT *, qx // 2 AS gx, qy // 2 AS gy, qx % 2 + 2 * (qy % 2) AS corner FROM q WHERE slide_key NOT IN (SELECT slide_key FROM bad)),
grp AS (SELECT slide_key, gx, gy, list(tile_index ORDER BY corner) AS m, list(corner ORDER BY corner) AS c,
  arg_min(coord_x, corner) AS coord_x, arg_min(coord_y, corner) AS coord_y FROM cell GROUP BY 1, 2, 3)"""


@query("e1_grid_steps", needs="grid_tiles", sql=f"WITH {_STEPS} SELECT slide_key, step_x, step_y, x0, y0 FROM steps")
def e1(spark, sf):
    return pooling.grid_steps(fx.grid_tiles(spark, sf)).select("slide_key", "step_x", "step_y", "x0", "y0")


@query("e2_geometry_rejects", needs="grid_tiles", sql=f"WITH {_REJECT} SELECT slide_key, reason FROM bad")
def e2(spark, sf):
    return pooling.geometry_rejects(fx.grid_tiles(spark, sf))


_MEMBERS = ", ".join(f"m[least({k}, len(m))] AS m{k - 1}" for k in (1, 2, 3, 4))


@query(
    "e3_complete_groups",
    needs="grid_tiles",
    sql=f"WITH {_REJECT} SELECT slide_key, gx, gy, coord_x, coord_y, {_MEMBERS} FROM grp WHERE len(m) = 4",
)
def e3(spark, sf):
    groups = pooling.pool_groups(fx.grid_tiles(spark, sf))
    return _spread(groups)


@query(
    "e4_partial_groups",
    needs="grid_tiles",
    sql=f"WITH {_REJECT} SELECT slide_key, gx, gy, coord_x, coord_y, {_MEMBERS} FROM grp WHERE c[1] = 0",
)
def e4(spark, sf):
    return _spread(pooling.pool_groups(fx.grid_tiles(spark, sf), require_complete=False))


def _spread(groups):
    members = [F.get("members", F.lit(k)).alias(f"m{k}") for k in range(4)]
    return groups.select("slide_key", "gx", "gy", "coord_x", "coord_y", *members)


@query(
    "e5_pool2x2",
    needs="grid_tiles tile_dims",
    d="x",
    sql=f"""WITH {_REJECT},
f AS (SELECT slide_key, gx, gy, coord_x, coord_y, row_number() OVER (PARTITION BY slide_key ORDER BY gy, gx) - 1 AS pooled, m
  FROM grp WHERE len(m) = 4),
u AS (SELECT slide_key, pooled, coord_x, coord_y, unnest(m) AS tile_index FROM f)
SELECT u.slide_key, u.pooled AS tile_index, u.coord_x, u.coord_y, d.dim, avg(d.x) AS x
FROM u JOIN tile_dims d ON u.slide_key = d.slide_key AND u.tile_index = d.tile_index GROUP BY ALL""",
)
def e5(spark, sf):
    pooled = pooling.pool2x2(fx.grid_tiles(spark, sf))
    return pooled.select("slide_key", "tile_index", "coord_x", "coord_y", F.posexplode("features").alias("dim", "x"))


@query(
    "e5_pool2x2_partial",
    needs="grid_tiles tile_dims",
    d="x",
    sql=f"""WITH {_REJECT},
f AS (SELECT slide_key, gx, gy, coord_x, coord_y, row_number() OVER (PARTITION BY slide_key ORDER BY gy, gx) - 1 AS pooled, m FROM grp WHERE c[1] = 0),
u AS (SELECT slide_key, pooled, coord_x, coord_y, m[least(k, len(m))] AS tile_index FROM f CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k))
SELECT u.slide_key, u.pooled AS tile_index, u.coord_x, u.coord_y, d.dim, avg(d.x) AS x
FROM u JOIN tile_dims d ON u.slide_key = d.slide_key AND u.tile_index = d.tile_index GROUP BY ALL""",
)
def e5_partial(spark, sf):
    """Blocks at the edge repeat their last member up to four."""
    pooled = pooling.pool2x2(fx.grid_tiles(spark, sf), require_complete=False)
    return pooled.select("slide_key", "tile_index", "coord_x", "coord_y", F.posexplode("features").alias("dim", "x"))


@query(
    "e6_preflight",
    needs="grid_tiles",
    sql=f"""WITH {_REJECT}, c AS (SELECT slide_key, count(*) AS n FROM grp WHERE len(m) = 4 GROUP BY 1)
SELECT count(*) AS usable_slides, CAST(sum(n) AS BIGINT) AS tiles_total, min(n) AS tiles_min,
  CAST(floor(median(n)) AS BIGINT) AS tiles_median, max(n) AS tiles_max, (SELECT count(*) FROM bad) AS invalid_slides FROM c""",
)
def e6(spark, sf):
    return pooling.preflight(fx.grid_tiles(spark, sf))
