"""Encoding: tiles x latent weights, fused with the aggregate that follows it.

The activation matrix (tiles x latents) is never stored. A block of the weight
table is broadcast (its size is checked; larger models are split into latent
blocks, one pass each) and every Arrow batch is multiplied by it inside the
task, which then emits only partial aggregates, top candidates or hits.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentlake.functions import vectors
from latentlake.runtime import MODEL_BLOCK_BYTES

#: Bytes of one activation chunk inside a task.
CHUNK_BYTES = 32 << 20
#: Bytes of open slides in the per-slide kernel.
OPEN_BYTES = 64 << 20
KEYS = ("slide_key", "tile_index")
PLACED = ("slide_key", "tile_index", "coord_x", "coord_y")


@dataclass(frozen=True)
class LatentModel:
    """Encoder weights ``(latent_idx, w, b)`` plus the activation rule.

    ``kind`` is ``dense`` (ReLU), ``topk`` (k hits per tile) or ``batch_topk``
    (k x B hits per chunk of B tiles). ``mode`` ranks hits by ``value`` or
    ``magnitude``; ``nonneg`` applies ReLU before ranking.
    """

    encoder: DataFrame
    kind: str = "dense"
    k: int = 32
    mode: str = "value"
    nonneg: bool = False
    chunk_tiles: int = 512
    input_norm: bool = False
    b_pre: tuple[float, ...] | None = None
    dtype: str = "float64"
    block_bytes: int = MODEL_BLOCK_BYTES
    _shape: list = field(default_factory=list, repr=False, compare=False)

    def shape(self) -> tuple[int, int]:
        """(latent_dim, d_in), from one aggregate row."""
        if not self._shape:
            row = self.encoder.agg(
                F.coalesce(F.max("latent_idx") + 1, F.lit(0)).alias("l"),
                F.coalesce(F.max(F.size("w")), F.lit(0)).alias("d"),
                F.coalesce(F.min(F.size("w")), F.lit(0)).alias("d0"),
            ).first()
            if row["d"] != row["d0"]:
                raise ValueError("encoder rows differ in length")
            self._shape.append((int(row["l"]), int(row["d"])))
        return self._shape[0]

    def as_dense(self) -> LatentModel:
        """Same weights read with plain ReLU (used by the analytics tables)."""
        return replace(self, kind="dense")


@dataclass(frozen=True)
class _Block:
    """One broadcastable slice of the encoder."""

    ids: np.ndarray
    w: np.ndarray
    b: np.ndarray
    b_pre: np.ndarray
    kind: str
    k: int
    by_magnitude: bool
    nonneg: bool
    input_norm: bool

    def pre(self, x: np.ndarray) -> np.ndarray:
        if self.input_norm:
            mu = x.mean(axis=1, keepdims=True)
            x = (x - mu) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
        return (x - self.b_pre) @ self.w + self.b

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Activations (zero outside the hits) and the hit mask."""
        a = self.pre(x)
        if self.kind == "dense":
            np.maximum(a, 0.0, out=a)
            return a, a > 0
        keep, a = top_mask(a, self.k, self.by_magnitude, self.nonneg, axis=1)
        return np.where(keep, a, 0.0), keep


def top_mask(a: np.ndarray, k: int, by_magnitude: bool, nonneg: bool, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the k best entries along ``axis``; ties go to the lower position."""
    if nonneg:
        a = np.maximum(a, 0.0)
    s = np.abs(a) if by_magnitude and not nonneg else a
    n = s.shape[axis]
    if k >= n:
        return np.ones_like(s, dtype=bool), a
    cut = np.take(np.partition(s, n - k, axis=axis), [n - k], axis=axis)
    above, tied = s > cut, s == cut
    spare = k - above.sum(axis=axis, keepdims=True)
    return above | (tied & (np.cumsum(tied, axis=axis) <= spare)), a


def _blocks(model: LatentModel, latents: DataFrame | None) -> Iterator[_Block]:
    """Collect the encoder in latent blocks of bounded size, one after the other."""
    latent_dim, d_in = model.shape()
    table = model.encoder.select("latent_idx", "w", "b")
    if latents is not None:
        table = table.join(latents.select("latent_idx").distinct(), "latent_idx", "left_semi")
    item = np.dtype(model.dtype).itemsize
    per_block = max(1, int(model.block_bytes // max(1, d_in * item)))
    for lo in range(0, max(latent_dim, 1), per_block):
        one = latent_dim <= per_block
        rows = (table if one else table.where(F.col("latent_idx").between(lo, lo + per_block - 1))).toArrow()
        rows = rows.sort_by("latent_idx")
        if rows.num_rows == 0:
            continue
        w = rows.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        b_pre = np.zeros(d_in) if model.b_pre is None else np.asarray(model.b_pre)
        yield _Block(
            ids=rows.column("latent_idx").to_numpy().astype(np.int64),
            w=np.ascontiguousarray(w.reshape(rows.num_rows, d_in).astype(model.dtype).T),
            b=rows.column("b").to_numpy().astype(model.dtype),
            b_pre=b_pre.astype(model.dtype),
            kind=model.kind,
            k=model.k,
            by_magnitude=model.mode == "magnitude",
            nonneg=model.nonneg,
            input_norm=model.input_norm,
        )


def feature_matrix(column: pa.Array, d_in: int, dtype) -> np.ndarray:
    """Arrow list column to a dense (rows, d_in) matrix."""
    lengths = column.value_lengths()
    if column.null_count or not bool(np.all(lengths.to_numpy(zero_copy_only=False) == d_in)):
        raise ValueError(f"feature vectors must have length {d_in}; filter with health() first")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d_in).astype(dtype, copy=False)


def _chunks(batches: Iterator[pa.RecordBatch], block: _Block) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches small enough that rows x latents stays within CHUNK_BYTES."""
    d_in, width = block.w.shape
    rows = max(1, CHUNK_BYTES // (block.w.dtype.itemsize * max(1, width)))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, feature_matrix(part.column("features"), d_in, block.w.dtype)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _over_blocks(
    tiles: DataFrame, model: LatentModel, latents: DataFrame | None, kernel: Callable, schema: str, keys: tuple[str, ...]
) -> DataFrame:
    source = tiles.select(*keys, "features")
    sc = tiles.sparkSession.sparkContext
    parts = []
    for block in _blocks(model, latents):
        parts.append(source.mapInArrow(partial(kernel, sc.broadcast(block)), schema))
    if not parts:
        return tiles.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)


# --- (a) per-latent partial aggregates -------------------------------------------------

_STATS = "latent_idx bigint, n_tiles bigint, z_max double, z_sum double, z_sum_sq double, nnz bigint"
_STATS_ARROW = pa.schema(
    [
        ("latent_idx", pa.int64()),
        ("n_tiles", pa.int64()),
        ("z_max", pa.float64()),
        ("z_sum", pa.float64()),
        ("z_sum_sq", pa.float64()),
        ("nnz", pa.int64()),
    ]
)


def _stats_kernel(handle, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: _Block = handle.value
    width = len(block.ids)
    top = np.full(width, -np.inf)
    total, squares, nnz, n = np.zeros(width), np.zeros(width), np.zeros(width, dtype=np.int64), 0
    for _, x in _chunks(batches, block):
        z, hit = block.hits(x)
        n += len(z)
        seen = z if block.kind == "dense" else np.where(hit, z, -np.inf)
        np.maximum(top, seen.max(axis=0), out=top)
        total += z.sum(axis=0, dtype=np.float64)
        squares += np.einsum("ij,ij->j", z, z, dtype=np.float64)
        nnz += hit.sum(axis=0)
    if n:
        top = pa.array(top, mask=~np.isfinite(top))
        yield _batch(_STATS_ARROW, block.ids, np.full(width, n), top, total, squares, nnz)


def encode_stats(tiles: DataFrame, model: LatentModel) -> DataFrame:
    """One row per latent: tiles seen, max, sum, sum of squares, hits (G1, fused).

    Each task emits one row per latent, so the shuffle holds latents x tasks rows
    whatever the number of tiles.
    """
    if model.kind == "topk" and _needs_split(model) or model.kind == "batch_topk":
        return _stats_of_hits(tiles, model)
    return (
        _over_blocks(tiles, model, None, _stats_kernel, _STATS, ())
        .groupBy("latent_idx")
        .agg(
            F.sum("n_tiles").alias("n_tiles"),
            F.max("z_max").alias("z_max"),
            F.sum("z_sum").alias("z_sum"),
            F.sum("z_sum_sq").alias("z_sum_sq"),
            F.sum("nnz").alias("nnz"),
        )
    )


def _stats_of_hits(tiles: DataFrame, model: LatentModel) -> DataFrame:
    """The same rows from hits: latents that no tile hits keep a row with a null maximum, as in the fused pass."""
    from latentlake.operators.stats import latent_partials

    n_tiles = tiles.agg(F.count("*").alias("n")).scalar()
    seen = latent_partials(encode_hits(tiles, model), n_tiles).drop("n_tiles")
    every = model.encoder.select("latent_idx").withColumn("n_tiles", n_tiles).where("n_tiles > 0")
    return every.join(seen, "latent_idx", "left").select(
        "latent_idx", "n_tiles", "z_max", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("z_sum", "z_sum_sq")), F.coalesce("nnz", F.lit(0)).alias("nnz")
    )


def _needs_split(model: LatentModel) -> bool:
    latent_dim, d_in = model.shape()
    return latent_dim * d_in * np.dtype(model.dtype).itemsize > model.block_bytes


# --- (b) per-(slide, latent) partial aggregates -----------------------------------------

_SLIDE = (
    "slide_key string, latent_idx bigint, z_max double, z_sum double, z_sum_sq double, pos_sum double, "
    "pos_n bigint, nz_n bigint"
)
_SLIDE_ARROW = pa.schema(
    [
        ("slide_key", pa.string()),
        ("latent_idx", pa.int64()),
        ("z_max", pa.float64()),
        ("z_sum", pa.float64()),
        ("z_sum_sq", pa.float64()),
        ("pos_sum", pa.float64()),
        ("pos_n", pa.int64()),
        ("nz_n", pa.int64()),
    ]
)


def _slide_kernel(handle, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accumulates slides in any row order.

    Tiles of a chunk are grouped by slide; up to OPEN_BYTES of slides stay open, and the one that was touched longest ago
    is emitted when another needs room. So a task emits about slides x firing latents rows however its tiles are ordered.
    """
    block: _Block = handle.value
    most = max(1, OPEN_BYTES // (6 * 8 * max(1, len(block.ids))))
    held: OrderedDict[str, list[np.ndarray]] = OrderedDict()

    def flush(current, state):
        live = np.flatnonzero(state[5])
        return _batch(
            _SLIDE_ARROW, [current] * len(live), block.ids[live], *(a[live] for a in state[:4]),
            state[4][live].astype(np.int64), state[5][live].astype(np.int64),
        )

    for part, x in _chunks(batches, block):
        z, _ = block.hits(x)
        codes, names = pd.factorize(np.asarray(part.column("slide_key").to_pylist(), dtype=object), use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        z, codes = z[order], codes[order]
        edges = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(codes)]):
            run, pos = z[lo:hi], z[lo:hi] > 0
            current = names[codes[lo]]
            state = held.pop(current, None)
            if state is None:
                if len(held) >= most:
                    yield flush(*held.popitem(last=False))
                state = [np.full(z.shape[1], -np.inf)] + [np.zeros(z.shape[1]) for _ in range(5)]
            held[current] = state
            np.maximum(state[0], run.max(axis=0), out=state[0])
            state[1] += run.sum(axis=0, dtype=np.float64)
            state[2] += np.einsum("ij,ij->j", run, run, dtype=np.float64)
            state[3] += np.where(pos, run, 0.0).sum(axis=0, dtype=np.float64)
            state[4] += pos.sum(axis=0)
            state[5] += (run != 0).sum(axis=0)
    for item in held.items():
        yield flush(*item)


def encode_slide_stats(tiles: DataFrame, model: LatentModel, latents: DataFrame | None = None) -> DataFrame:
    """Per (slide, latent) partials for latents that are non-zero somewhere in the slide."""
    if model.kind == "topk" and _needs_split(model) or model.kind == "batch_topk":
        from latentlake.operators.stats import slide_partials

        hits = encode_hits(tiles, model)
        if latents is not None:
            hits = hits.join(F.broadcast(latents), "latent_idx", "left_semi")
        return slide_partials(hits)
    # a hit rule over all latents must see all of them; slice the weights only for plain ReLU
    wanted = latents if model.kind == "dense" else None
    out = (
        _over_blocks(tiles, model, wanted, _slide_kernel, _SLIDE, ("slide_key",))
        .groupBy("slide_key", "latent_idx")
        .agg(
            F.max("z_max").alias("z_max"),
            F.sum("z_sum").alias("z_sum"),
            F.sum("z_sum_sq").alias("z_sum_sq"),
            F.sum("pos_sum").alias("pos_sum"),
            F.sum("pos_n").alias("pos_n"),
            F.sum("nz_n").alias("nz_n"),
        )
    )
    if latents is not None and wanted is None:
        out = out.join(latents.select("latent_idx").distinct(), "latent_idx", "left_semi")
    return out


# --- (c) top-N candidates per latent ----------------------------------------------------

_TOP = "latent_idx bigint, slide_key string, tile_index bigint, coord_x int, coord_y int, z double"
_ROW_ARROW = pa.schema(
    [
        ("latent_idx", pa.int64()),
        ("slide_key", pa.string()),
        ("tile_index", pa.int64()),
        ("coord_x", pa.int32()),
        ("coord_y", pa.int32()),
        ("z", pa.float64()),
    ]
)


def _hit_frame(part: pa.RecordBatch, block: _Block, z: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
    rows, cols = np.nonzero(mask)
    meta = part.select(list(PLACED)).to_pandas()
    out = meta.iloc[rows].reset_index(drop=True)
    out.insert(0, "latent_idx", block.ids[cols])
    out["z"] = z[rows, cols].astype(np.float64)
    return out


def _best(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    frame = frame.sort_values(["latent_idx", "z", "slide_key", "tile_index"], ascending=[True, False, True, True])
    return frame.groupby("latent_idx", sort=False).head(n)


def _top_kernel(n: int, handle, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running best n per latent; rows below a latent's n-th best never leave the task."""
    block: _Block = handle.value
    width = len(block.ids)
    column = pd.Series(np.arange(width), index=block.ids)
    floor = np.full(width, -np.inf)
    held: list[pd.DataFrame] = []
    count, limit = 0, max(4 * n * width, 50_000)
    for part, x in _chunks(batches, block):
        z, hit = block.hits(x)
        mask = hit & (z >= floor)
        held.append(_hit_frame(part, block, z, mask))
        count += len(held[-1])
        if count > limit:
            best = _best(pd.concat(held), n)
            tail = best.groupby("latent_idx")["z"].agg(["size", "min"])
            tail = tail[tail["size"] >= n]
            floor[column[tail.index].to_numpy()] = tail["min"].to_numpy()
            held, count = [best], len(best)
            limit = max(limit, 2 * count)
    if count:
        yield pa.RecordBatch.from_pandas(_best(pd.concat(held), n), schema=_ROW_ARROW, preserve_index=False)


def encode_top(tiles: DataFrame, model: LatentModel, n: int, latents: DataFrame | None = None) -> DataFrame:
    """Best ``n`` tiles per latent with ``source_rank`` (H4, fused)."""
    if model.kind != "dense":
        hits = encode_hits(tiles, model)
        if latents is not None:
            hits = hits.join(latents.select("latent_idx").distinct(), "latent_idx", "left_semi")
        return rank_top(hits, n)
    return rank_top(_over_blocks(tiles, model, latents, partial(_top_kernel, n), _TOP, PLACED), n)


def rank_top(acts: DataFrame, n: int) -> DataFrame:
    """``source_rank`` 1..n per latent: z desc, then slide, then tile.

    The planner puts a per-partition group limit below the shuffle, so a hot
    latent sends at most n rows per task.
    """
    order = Window.partitionBy("latent_idx").orderBy(F.col("z").desc(), "slide_key", "tile_index")
    return acts.withColumn("source_rank", F.row_number().over(order)).where(F.col("source_rank") <= n)


# --- (d) hits and codes -----------------------------------------------------------------


def _hits_kernel(handle, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: _Block = handle.value
    for part, x in _chunks(batches, block):
        z, hit = block.hits(x)
        yield pa.RecordBatch.from_pandas(_hit_frame(part, block, z, hit), schema=_ROW_ARROW, preserve_index=False)


def _pre_kernel(handle, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: _Block = handle.value
    for part, x in _chunks(batches, block):
        a = block.pre(x)
        frame = _hit_frame(part, block, a, np.ones(a.shape, dtype=bool))
        yield pa.RecordBatch.from_pandas(frame, schema=_ROW_ARROW, preserve_index=False)


def encode_hits(tiles: DataFrame, model: LatentModel, latents: DataFrame | None = None) -> DataFrame:
    """Long table of hits ``(latent_idx, slide_key, tile_index, coord_x, coord_y, z)``.

    Dense models give z > 0; TopK kinds give every hit, sign kept (V4-V7, C3).
    """
    if model.kind == "batch_topk":
        out = _batch_topk(tiles, model)
    elif model.kind == "topk":
        out = _over_blocks(tiles, model, None, _hits_kernel, _TOP, PLACED)
        if _needs_split(model):
            # the k best of a tile are among the k best of each latent block
            out = topk(out, model.k, model.mode)
    else:
        return _over_blocks(tiles, model, latents, _hits_kernel, _TOP, PLACED)
    if latents is not None:
        out = out.join(latents.select("latent_idx").distinct(), "latent_idx", "left_semi")
    return out


def pre_activations(tiles: DataFrame, model: LatentModel) -> DataFrame:
    """Long table of every affine output before any activation rule (small models)."""
    return _over_blocks(tiles, model, None, _pre_kernel, _TOP, PLACED)


def _batch_topk_kernel(handle, k: int, table: pa.Table) -> pa.Table:
    block: _Block = handle.value
    part = table.sort_by("tile_index").combine_chunks().to_batches()[0]
    a = block.pre(feature_matrix(part.column("features"), block.w.shape[0], block.w.dtype))
    budget = max(1, min(k * len(a), a.size))
    # latent-major order so that equal scores go to the lower latent, then the lower tile
    keep, flat = top_mask(a.T.reshape(-1), budget, block.by_magnitude, block.nonneg, axis=0)
    keep, a = keep.reshape(a.T.shape).T, flat.reshape(a.T.shape).T
    return pa.Table.from_pandas(_hit_frame(part, block, a, keep), schema=_ROW_ARROW, preserve_index=False)


def _batch_topk(tiles: DataFrame, model: LatentModel) -> DataFrame:
    """Groups are single chunks of ``chunk_tiles`` tiles, so no group grows with the data."""
    if _needs_split(model):
        from latentlake.operators import split

        return split.hits(tiles, model)
    (block,) = _blocks(model, None)
    handle = tiles.sparkSession.sparkContext.broadcast(block)
    k = model.k
    return (
        _chunked(tiles, model.chunk_tiles)
        .select("chunk", *PLACED, "features")
        .groupBy("slide_key", "chunk")
        .applyInArrow(lambda table: _batch_topk_kernel(handle, k, table), _TOP)
    )


def _chunked(tiles: DataFrame, chunk_tiles: int) -> DataFrame:
    """Tiles with the number of their chunk of ``chunk_tiles`` positions in the slide."""
    from latentlake.operators.sampling import tile_position

    return tile_position(tiles).withColumn("chunk", F.floor(F.col("pos") / chunk_tiles))


def topk(acts: DataFrame, k: int, mode: str = "value", nonneg: bool = False) -> DataFrame:
    """k best latents per tile from a long table (V5); ties go to the lower latent."""
    if nonneg:
        acts = acts.withColumn("z", F.greatest("z", F.lit(0.0)))
    score = F.abs("z") if mode == "magnitude" and not nonneg else F.col("z")
    order = Window.partitionBy(*KEYS).orderBy(score.desc(), "latent_idx")
    return acts.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def hits_from_arrays(df: DataFrame, idx: str = "topk_idx", val: str = "topk_val") -> DataFrame:
    """Flatten per-tile arrays of (latent, value) into hit rows (V7)."""
    pairs = F.explode(F.arrays_zip(F.col(idx).alias("i"), F.col(val).alias("v")))
    rest = [c for c in df.columns if c not in (idx, val)]
    flat = df.select(*rest, pairs.alias("_p"))
    return flat.select(*rest, F.col("_p.i").cast("bigint").alias("latent_idx"), F.col("_p.v").cast("double").alias("z"))


def encode_sql(tiles: DataFrame, encoder: DataFrame, max_latents: int = 4096) -> DataFrame:
    """Expression-only ReLU encode for small models; the fused kernels must agree with it."""
    if encoder.limit(max_latents + 1).count() > max_latents:
        raise ValueError("expression encode is for small models; use encode_hits")
    units = encoder.agg(F.collect_list(F.struct("latent_idx", "w", "b")).alias("u")).scalar()
    long = tiles.withColumn("_u", F.explode(units))
    z = vectors.dot(F.col("features"), F.col("_u.w")) + F.col("_u.b")
    return long.select(
        *[c for c in PLACED if c in tiles.columns],
        F.col("_u.latent_idx").alias("latent_idx"),
        F.greatest(z, F.lit(0.0)).alias("z"),
    )


# --- (e) monitors and single concepts ------------------------------------------------------

_MONITOR = "n_tiles bigint, nz double, z_sum double, z_sum_sq double, gap double"
_MONITOR_ARROW = pa.schema(
    [("n_tiles", pa.int64())] + [(c, pa.float64()) for c in ("nz", "z_sum", "z_sum_sq", "gap")]
)


def _monitor_kernel(handle, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: _Block = handle.value
    n, sums = 0, np.zeros(4)
    for _, x in _chunks(batches, block):
        z, _ = block.hits(x)
        n += len(z)
        gap = 0.0
        if z.shape[1] > 1:
            best = np.partition(z, z.shape[1] - 2, axis=1)[:, -2:]
            gap = (best[:, 1] - best[:, 0]).sum(dtype=np.float64)
        sums += [np.count_nonzero(z), z.sum(dtype=np.float64), np.vdot(z, z), gap]
    if n:
        yield _batch(_MONITOR_ARROW, [n], *([v] for v in sums))


def encode_monitor(tiles: DataFrame, model: LatentModel) -> DataFrame:
    """Activation monitor from one row per task (G24, fused); hits are never written out."""
    from latentlake.operators.stats import monitor_ratios

    latent_dim, _ = model.shape()
    if model.kind == "batch_topk" or _needs_split(model):
        # the two largest latents of a tile may lie in different blocks
        from latentlake.operators import split

        return monitor_ratios(split.monitor_parts(tiles, model), latent_dim)
    parts = _over_blocks(tiles, model, None, _monitor_kernel, _MONITOR, ())
    return monitor_ratios(parts, latent_dim)


_CONCEPT = "slide_key string, tile_index bigint, concept_score double"


def _concept_kernel(latent: int, k: int, use_margin: bool, handle, batches: Iterator[pa.RecordBatch]):
    block: _Block = handle.value
    at = int(np.searchsorted(block.ids, latent))
    best = None
    for part, x in _chunks(batches, block):
        z, _ = block.hits(x)
        score = z[:, at].astype(np.float64)
        if use_margin and z.shape[1] > 1:
            score = score - np.delete(z, at, axis=1).max(axis=1)
        frame = part.select(list(KEYS)).to_pandas()
        frame["concept_score"] = score
        if best is not None:
            frame = pd.concat([best, frame])
        best = frame.sort_values(["concept_score", *KEYS], ascending=[False, True, True]).head(k)
    if best is not None:
        yield pa.RecordBatch.from_pandas(best, preserve_index=False)


def encode_concept(tiles: DataFrame, model: LatentModel, latent: int, k: int, use_margin: bool = True) -> DataFrame:
    """Best k tiles of one latent, zeros included (H16, fused); a task emits at most k rows."""
    if model.kind == "batch_topk" or _needs_split(model):
        from latentlake.operators import split

        scored = split.concept(tiles, model, latent, k, use_margin)
    else:
        kernel = partial(_concept_kernel, latent, k, use_margin)
        scored = _over_blocks(tiles, model, None, kernel, _CONCEPT, KEYS)
    return scored.orderBy(F.col("concept_score").desc(), *KEYS).limit(k)


# --- decode -----------------------------------------------------------------------------


def _decode_kernel(handle, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, decoder = handle.value
    for part, x in _chunks(batches, block):
        z, _ = block.hits(x)
        x_hat = z @ decoder
        offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * decoder.shape[1])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("slide_key").cast(pa.string()),
                part.column("tile_index").cast(pa.int64()),
                part.column("features"),
                pa.ListArray.from_arrays(offsets, pa.array(x_hat.reshape(-1).astype(np.float64))),
                pa.array(np.abs(z).sum(axis=1).astype(np.float64)),
            ],
            names=["slide_key", "tile_index", "features", "x_hat", "z_l1"],
        )


def reconstruct(
    tiles: DataFrame, model: LatentModel, decoder: DataFrame | None = None, b_dec: tuple[float, ...] | None = None
) -> DataFrame:
    """Tiles with ``x_hat`` and ``z_l1`` (V8). ``decoder`` is (latent_idx, w); tied when absent."""
    if model.kind == "batch_topk" or _needs_split(model):
        from latentlake.operators import split

        out = split.reconstruct(tiles, model, decoder)
    else:
        sc = tiles.sparkSession.sparkContext
        kind = tiles.schema["features"].dataType.simpleString()
        schema = f"slide_key string, tile_index bigint, features {kind}, x_hat array<double>, z_l1 double"
        (block,) = _blocks(model, None)
        if decoder is None:
            table = block.w.T
        else:
            rows = decoder.where(F.col("latent_idx").between(int(block.ids[0]), int(block.ids[-1]))).toArrow()
            rows = rows.sort_by("latent_idx")
            table = rows.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            table = table.reshape(rows.num_rows, -1).astype(model.dtype)
        out = tiles.select(*KEYS, "features").mapInArrow(partial(_decode_kernel, sc.broadcast((block, table))), schema)
    if b_dec is not None:
        bias = F.array(*[F.lit(float(v)) for v in b_dec])
        out = out.withColumn("x_hat", F.zip_with("x_hat", bias, lambda a, b: a + b))
    return out


def decode(acts: DataFrame, decoder: DataFrame, b_dec: DataFrame | None = None) -> DataFrame:
    """``x_hat`` per (tile, dim) from sparse hits: join on the latent, sum per dim (V8, any kind)."""
    weights = decoder.select("latent_idx", F.posexplode("w").alias("dim", "weight"))
    out = (
        acts.select(*KEYS, "latent_idx", "z")
        .join(weights, "latent_idx")
        .groupBy(*KEYS, "dim")
        .agg(F.sum(F.col("z") * F.col("weight")).alias("x_hat"))
    )
    if b_dec is not None:
        out = out.join(b_dec, "dim").withColumn("x_hat", F.col("x_hat") + F.col("b")).drop("b")
    return out


def decoder_dictionary(weights: DataFrame) -> DataFrame:
    """Decoder as ``(dim, latent_idx, weight)``; pass encoder rows for a tied model (V9)."""
    return weights.select("latent_idx", F.posexplode("w").alias("dim", "weight")).select("dim", "latent_idx", "weight")


# --- two-level coefficients ---------------------------------------------------------------


def coefficients(level2: DataFrame, nonneg: bool = False, simplex: bool = False) -> DataFrame:
    """Level-2 coefficients per latent: softmax, softplus or raw."""
    raw = F.col("coeff")
    value: Column = vectors.softmax(raw) if simplex else vectors.softplus(raw) if nonneg else raw
    return level2.withColumn("coeff", value)


def parent_assignment(coeffs: DataFrame) -> DataFrame:
    """Parent with the largest coefficient, the first on ties."""
    parent = F.array_position("coeff", F.array_max("coeff")) - 1
    return coeffs.select("latent_idx", parent.cast("bigint").alias("parent"))


def margin(acts: DataFrame, latent_dim: int) -> DataFrame:
    """``z_j - max of the other latents`` per hit row; absent latents count as zero."""
    tile = Window.partitionBy(*KEYS)
    order = tile.orderBy(F.col("z").desc(), "latent_idx")
    ranked = acts.withColumn("_rn", F.row_number().over(order)).withColumn("_n", F.count("*").over(tile))
    best = F.max(F.when(F.col("_rn") == 1, F.col("z"))).over(tile)
    second = F.max(F.when(F.col("_rn") == 2, F.col("z"))).over(tile)
    other = F.when(F.col("_rn") == 1, second).otherwise(best)
    implicit = F.when(F.col("_n") < latent_dim, F.lit(0.0))
    value = F.col("z") - F.coalesce(F.greatest(other, implicit), F.lit(0.0))
    return ranked.withColumn("margin", value).drop("_rn", "_n")
