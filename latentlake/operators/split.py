"""Encoders larger than one block, in one pass over the tiles.

A task holds a bounded number of tiles and lets the weight blocks go by, one at a time. What a tile or a chunk of tiles needs from all latents
(its best k, the k x B best of a chunk, the two largest activations, the decoded vector) is merged block by block inside the task, so that
neither hits nor partial vectors are shuffled. A weight block is read again for each group of held tiles; with ``HELD_BYTES`` of tiles in a
group its multiplication takes far longer than its reading.

The chunks of a ``batch_topk`` model are brought together first: tiles move once, by (slide, chunk).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.operators import encode
from latentlake.operators.encode import KEYS, PLACED, LatentModel, _batch, _Block, _blocks, _chunked, feature_matrix, top_mask

#: Bytes of tile vectors that a task holds while the blocks go by.
HELD_BYTES = 128 << 20


def _broadcast(tiles: DataFrame, model: LatentModel) -> list:
    """One broadcast per weight block; the driver holds one block at a time."""
    sc = tiles.sparkSession.sparkContext
    return [sc.broadcast(block) for block in _blocks(model, None)]


def _values(handles: list) -> Iterator:
    """The broadcast values in turn, each forgotten by the worker before the next is read."""
    for handle in handles:
        yield handle.value
        handle.__dict__.pop("_value", None)


def _source(tiles: DataFrame, model: LatentModel, keys: tuple[str, ...]) -> DataFrame:
    """Tiles in any order, or with the rows of each chunk one after the other."""
    if model.kind != "batch_topk":
        return tiles.select(*keys, "features")
    rows = _chunked(tiles, model.chunk_tiles).select("chunk", *keys, "features")
    return rows.repartition("slide_key", "chunk").sortWithinPartitions("slide_key", "chunk", "tile_index")


def _edges(part: pa.RecordBatch) -> np.ndarray:
    """First rows of the chunks of a table in chunk order."""
    slide = pd.factorize(np.asarray(part.column("slide_key").to_pylist(), dtype=object), use_na_sentinel=False)[0]
    chunk = part.column("chunk").to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (slide[1:] != slide[:-1]) | (chunk[1:] != chunk[:-1])]))


def _groups(batches: Iterator[pa.RecordBatch], chunked: bool) -> Iterator[pa.RecordBatch]:
    """The rows in tables of about HELD_BYTES; chunks stay whole."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) < HELD_BYTES:
            continue
        whole = joined()
        cut = int(_edges(whole)[-1]) if chunked else whole.num_rows
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)] if cut < whole.num_rows else []
    if held:
        yield joined()


def _slices(block: _Block, rows: int) -> Iterator[tuple[_Block, np.ndarray]]:
    """Runs of latents for which ``rows`` tiles stay within CHUNK_BYTES of activations."""
    step = max(1, encode.CHUNK_BYTES // (block.w.dtype.itemsize * max(1, rows)))
    for lo in range(0, len(block.ids), step):
        yield slice(lo, lo + step)


def _affine(block: _Block, x: np.ndarray, latents: slice) -> np.ndarray:
    if block.input_norm:
        mu = x.mean(axis=1, keepdims=True)
        x = (x - mu) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
    return (x - block.b_pre) @ block.w[:, latents] + block.b[latents]


class Hits:
    """Best entries of each row range of held tiles: k x (rows of the range), ties to the lower latent, then the lower row.

    Blocks come in latent order, and candidates are kept in (latent, row) order, so what is there first wins a tie.
    """

    def __init__(self, edges: np.ndarray, n: int, k: int):
        self.ranges = list(zip(edges.tolist(), [*edges[1:].tolist(), n], strict=True))
        self.k = k
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.best = [empty] * len(self.ranges)

    def add(self, block: _Block, x: np.ndarray) -> None:
        for i, (lo, hi) in enumerate(self.ranges):
            most = max(1, self.k * (hi - lo))
            for latents in _slices(block, hi - lo):
                a = _affine(block, x[lo:hi], latents).T
                keep, flat = top_mask(a.reshape(-1), min(most, a.size), block.by_magnitude, block.nonneg, axis=0)
                at = np.flatnonzero(keep)
                new = (lo + at % (hi - lo), block.ids[latents][at // (hi - lo)], flat[at])
                row, latent, z = (np.concatenate([old, n]) for old, n in zip(self.best[i], new, strict=True))
                keep, z = top_mask(z, min(most, len(z)), block.by_magnitude, block.nonneg, axis=0)
                self.best[i] = row[keep], latent[keep], z[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, latent, z) in order of row and latent."""
        row, latent, z = (np.concatenate([b[c] for b in self.best]) for c in range(3))
        order = np.lexsort((latent, row))
        return row[order], latent[order], z[order]


class RowHits:
    """The k best entries of each row, ties to the lower latent."""

    def __init__(self, n: int, k: int):
        self.k, self.latent, self.z = k, np.zeros((n, 0), np.int64), np.zeros((n, 0))

    def add(self, block: _Block, x: np.ndarray) -> None:
        n, step = len(x), max(1, encode.CHUNK_BYTES // (block.w.dtype.itemsize * max(1, len(block.ids))))
        latent, z = [], []
        for lo in range(0, n, step):
            keep, a = top_mask(block.pre(x[lo : lo + step]), self.k, block.by_magnitude, block.nonneg, axis=1)
            latent.append(block.ids[np.nonzero(keep)[1]].reshape(len(a), -1))
            z.append(a[keep].reshape(len(a), -1))
        latent, z = (np.concatenate([old, np.concatenate(new)], axis=1) for old, new in ((self.latent, latent), (self.z, z)))
        keep, z = top_mask(z, self.k, block.by_magnitude, block.nonneg, axis=1)
        self.latent, self.z = latent[keep].reshape(n, -1), z[keep].reshape(n, -1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = self.z.shape
        return np.repeat(np.arange(n), k), self.latent.reshape(-1), self.z.reshape(-1)


def _select(part: pa.RecordBatch, x: np.ndarray, handles: list, model: tuple[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, k = model
    found = Hits(_edges(part), len(x), k) if kind == "batch_topk" else RowHits(len(x), k)
    for block in _values(handles):
        found.add(block, x)
    return found.rows()


def _shape(handles: list) -> tuple[int, np.dtype]:
    block = next(_values(handles[:1]))
    return block.w.shape[0], block.w.dtype


def _held(handles: list, chunked: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    d_in, dtype = _shape(handles)
    for part in _groups(batches, chunked):
        yield part, feature_matrix(part.column("features"), d_in, dtype)


# --- hits -------------------------------------------------------------------------------


def _hits_kernel(handles: list, model: tuple[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, x in _held(handles, model[0] == "batch_topk", batches):
        row, latent, z = _select(part, x, handles, model)
        for lo in range(0, len(row), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            meta = part.select(list(PLACED)).take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(latent[at]), *(meta.column(c).cast(f.type) for c, f in zip(PLACED, list(encode._ROW_ARROW)[1:5], strict=True)), pa.array(z[at].astype(np.float64))],
                schema=encode._ROW_ARROW,
            )


def hits(tiles: DataFrame, model: LatentModel) -> DataFrame:
    """Hits of a ``topk`` or ``batch_topk`` model of any size (V5, V6)."""
    handles = _broadcast(tiles, model)
    kernel = partial(_hits_kernel, handles, (model.kind, model.k))
    return _source(tiles, model, PLACED).mapInArrow(kernel, encode._TOP)


# --- monitor and single concepts ------------------------------------------------------------


def _two_best(row: np.ndarray, z: np.ndarray, n: int, latent_dim: int) -> np.ndarray:
    """(n, 2): the two largest activations of each row; latents without a hit count as zero."""
    best = np.full((n, 2), -np.inf)
    order = np.lexsort((-z, row))
    row, z = row[order], z[order]
    first = np.searchsorted(row, np.arange(n))
    count = np.searchsorted(row, np.arange(n), "right") - first
    for i in (0, 1):
        have = count > i
        best[have, i] = z[first[have] + i]
    zeros = np.where(np.stack([latent_dim - count > 0, latent_dim - count > 1], axis=1), 0.0, -np.inf)
    return -np.sort(-np.concatenate([best, zeros], axis=1), axis=1)[:, :2]


def _dense_slices(block: _Block, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    step = max(1, encode.CHUNK_BYTES // (block.w.dtype.itemsize * max(1, len(block.ids))))
    for lo in range(0, len(x), step):
        yield slice(lo, lo + step), np.maximum(block.pre(x[lo : lo + step]), 0.0)


def _monitor_kernel(handles: list, model: tuple[str, int], latent_dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, np.zeros(4)
    for part, x in _held(handles, model[0] == "batch_topk", batches):
        n += len(x)
        if model[0] == "dense":
            best = np.full((len(x), 2), -np.inf)
            for block in _values(handles):
                for at, z in _dense_slices(block, x):
                    sums[:3] += [np.count_nonzero(z), z.sum(dtype=np.float64), np.vdot(z, z)]
                    two = np.partition(z, z.shape[1] - 2, axis=1)[:, -2:] if z.shape[1] > 1 else z
                    best[at] = -np.sort(-np.concatenate([best[at], two], axis=1), axis=1)[:, :2]
        else:
            row, _, z = _select(part, x, handles, model)
            sums[:3] += [np.count_nonzero(z), z.sum(dtype=np.float64), np.vdot(z, z)]
            best = _two_best(row, z.astype(np.float64), len(x), latent_dim)
        if latent_dim > 1:
            sums[3] += (best[:, 0] - best[:, 1]).sum(dtype=np.float64)
    if n:
        yield _batch(encode._MONITOR_ARROW, [n], *([v] for v in sums))


def monitor_parts(tiles: DataFrame, model: LatentModel) -> DataFrame:
    """One monitor row per task."""
    handles = _broadcast(tiles, model)
    keys = KEYS if model.kind == "batch_topk" else ()
    return _source(tiles, model, keys).mapInArrow(partial(_monitor_kernel, handles, (model.kind, model.k), model.shape()[0]), encode._MONITOR)


def _concept_kernel(
    handles: list, model: tuple[str, int], latent_dim: int, latent: int, k: int, use_margin: bool, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    best = None
    for part, x in _held(handles, model[0] == "batch_topk", batches):
        own, other = np.zeros(len(x)), np.full(len(x), -np.inf)
        if model[0] == "dense":
            for block in _values(handles):
                mine = block.ids == latent
                for at, z in _dense_slices(block, x):
                    if mine.any():
                        own[at] = z[:, mine][:, 0]
                    if not mine.all():
                        other[at] = np.maximum(other[at], z[:, ~mine].max(axis=1))
        else:
            row, found, z = _select(part, x, handles, model)
            mine = found == latent
            own[row[mine]] = z[mine]
            np.maximum.at(other, row[~mine], z[~mine].astype(np.float64))
            silent = np.bincount(row[~mine], minlength=len(x)) < latent_dim - 1
            other[silent] = np.maximum(other[silent], 0.0)
        frame = part.select(list(KEYS)).to_pandas()
        frame["concept_score"] = own - other if use_margin and latent_dim > 1 else own
        best = frame if best is None else pd.concat([best, frame])
        best = best.sort_values(["concept_score", *KEYS], ascending=[False, True, True]).head(k)
    if best is not None:
        yield pa.RecordBatch.from_pandas(best, preserve_index=False)


def concept(tiles: DataFrame, model: LatentModel, latent: int, k: int, use_margin: bool) -> DataFrame:
    """At most k rows per task: the best tiles of one latent."""
    handles = _broadcast(tiles, model)
    kernel = partial(_concept_kernel, handles, (model.kind, model.k), model.shape()[0], latent, k, use_margin)
    return _source(tiles, model, KEYS).mapInArrow(kernel, encode._CONCEPT)


# --- decode -----------------------------------------------------------------------------


def _decode_kernel(handles: list, decoders: list | None, model: tuple[str, int], d_out: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tables() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(latents, rows of the decoder) block by block; the encoder's columns if there is no decoder."""
        if decoders is None:
            yield from ((block.ids, block.w.T) for block in _values(handles))
        else:
            yield from _values(decoders)

    for part, x in _held(handles, model[0] == "batch_topk", batches):
        x_hat, l1 = np.zeros((len(x), d_out)), np.zeros(len(x))
        if model[0] == "dense":
            for block, (_, table) in zip(_values(handles), tables(), strict=True):
                for at, z in _dense_slices(block, x):
                    x_hat[at] += z @ table
                    l1[at] += z.sum(axis=1, dtype=np.float64)
        else:
            row, latent, z = _select(part, x, handles, model)
            l1 += np.bincount(row, np.abs(z), minlength=len(x))
            step = max(1, encode.CHUNK_BYTES // (8 * d_out))
            for ids, table in tables():
                inside = np.flatnonzero((latent >= ids[0]) & (latent <= ids[-1]))
                for lo in range(0, len(inside), step):
                    at = inside[lo : lo + step]
                    terms = table[np.searchsorted(ids, latent[at])] * z[at, None]
                    head = np.flatnonzero(np.concatenate([[True], row[at][1:] != row[at][:-1]]))
                    x_hat[row[at][head]] += np.add.reduceat(terms, head, axis=0)
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * d_out)
        vectors = pa.ListArray.from_arrays(offsets, pa.array(x_hat.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [part.column("slide_key").cast(pa.string()), part.column("tile_index").cast(pa.int64()), part.column("features"), vectors, pa.array(l1)],
            names=["slide_key", "tile_index", "features", "x_hat", "z_l1"],
        )


def reconstruct(tiles: DataFrame, model: LatentModel, decoder: DataFrame | None) -> DataFrame:
    """Tiles with ``x_hat`` and ``z_l1`` (V8), of any kind and any number of blocks; nothing is summed behind a shuffle."""
    sc, handles, decoders = tiles.sparkSession.sparkContext, [], None if decoder is None else []
    d_out = model.shape()[1]
    for block in _blocks(model, None):
        handles.append(sc.broadcast(block))
        if decoder is not None:
            rows = decoder.where(F.col("latent_idx").between(int(block.ids[0]), int(block.ids[-1]))).select("latent_idx", "w").toArrow().sort_by("latent_idx")
            table = rows.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(model.dtype)
            if not np.array_equal(rows.column("latent_idx").to_numpy(), block.ids):
                raise ValueError("decoder and encoder have different latents")
            decoders.append(sc.broadcast((block.ids, table)))
            d_out = table.shape[1]
    kind = tiles.schema["features"].dataType.simpleString()
    schema = f"slide_key string, tile_index bigint, features {kind}, x_hat array<double>, z_l1 double"
    return _source(tiles, model, KEYS).mapInArrow(partial(_decode_kernel, handles, decoders, (model.kind, model.k), d_out), schema)
