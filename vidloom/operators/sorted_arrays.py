"""Sorted arrays of long hash strings, spread over tasks by range.

A tree (or band) gives every vector a 63-bit string. The rows of a tree are
range partitioned by it, so that rows that share a long prefix meet in one task
and lie next to each other once sorted. Range borders are quantiles of a bounded
sample; a run of equal borders, which a hash value with a large share of the rows
causes, is spread over its ranges by the row's identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 64
#: Length of a hash string.
BITS = 63
#: Rows of the sample from which range borders are taken: a bound, not a share.
SAMPLE_ROWS = 20_000


def valid_vectors(frames: DataFrame, dims: int = DIMS, key: str = "frame_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``v``, the unit vector as ``dims`` little-endian float32.

    Only vectors of exactly ``dims`` finite numbers that are not all zero take part; null keys and null vectors
    are left out; other columns don't matter. A row that was delivered twice is still there twice.
    """
    rows = frames.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e")).where(F.col("id").isNotNull() & (F.size("e") == dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            e = np.asarray(x.column("e").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
            with np.errstate(all="ignore"):
                top = np.abs(e).max(axis=1)
                ok = np.isfinite(top) & (top > 0)
                e = e[ok] / top[ok, None]  # else tiny or huge numbers vanish when squared
                e /= np.sqrt((e * e).sum(axis=1))[:, None]
            yield pa.RecordBatch.from_arrays([x.column("id").filter(pa.array(ok)), binary(e.astype("<f4"))], names=["id", "v"])

    return rows.mapInArrow(run, "id bigint, v binary")


def binary(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    offsets = np.arange(len(a) + 1, dtype=np.int64) * width
    if len(a) * width < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(a.tobytes())])
    return pa.array([r.tobytes() for r in a], pa.binary())


def matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """A binary column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dims), kind)
    size = np.dtype(kind).itemsize * dims
    offset = np.frombuffer(column.buffers()[1], np.int32, count=1, offset=4 * column.offset)[0]
    return np.frombuffer(column.buffers()[2], kind, count=len(column) * dims, offset=int(offset)).reshape(-1, dims) if size else np.zeros((len(column), 0), kind)


def planes(trees: int, bits: int, dims: int, seed: int) -> np.ndarray:
    """Random hyperplanes, orthogonal within each run of ``dims``: trees x dims x bits."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        blocks = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-bits // dims))]
        out.append(np.concatenate(blocks, axis=1)[:, :bits])
    return np.array(out, dtype=np.float32)


def bit_strings(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first 63 signs of each row as a non-negative long, first bit highest."""
    out = np.zeros(len(u), np.int64)
    for a in range(0, len(u), 65_536):
        signs = u[a : a + 65_536] @ h > 0
        x = out[a : a + 65_536]
        for k in range(min(63, h.shape[1])):
            x <<= 1
            x |= signs[:, k]
    return out


def quantized(u: np.ndarray) -> np.ndarray:
    """Rows as int8 with their greatest component at 127; only directions count later."""
    return np.rint(u * (127 / np.maximum(np.abs(u).max(axis=1, keepdims=True), 1e-30))).astype(np.int8)


def unit(q: np.ndarray) -> np.ndarray:
    u = q.astype(np.float32)
    return u / np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-30)


def mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))).astype(np.uint64)


def borders(keys: np.ndarray, parts: int) -> np.ndarray:
    """parts - 1 quantiles of a sample of keys."""
    if not len(keys) or parts < 2:
        return np.zeros(0, np.int64)
    s = np.sort(keys)
    return s[(np.arange(1, parts) * len(s)) // parts]


def range_of(keys: np.ndarray, edges: np.ndarray, ids: np.ndarray, salt: int = 0) -> np.ndarray:
    """Range of each key; equal edges share their key's rows by identifier, in another way for each ``salt``."""
    lo, hi = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
    return lo + (mixed(ids ^ salt * 0x632BE5AB) % (hi - lo + 1).astype(np.uint64)).astype(np.int64)


def sample_vectors(vectors: DataFrame, rows: int, n: int) -> np.ndarray:
    """About ``n`` vectors of ``rows``, chosen by a hash of the identifier."""
    every = max(1, rows // n)
    got = vectors.where(F.pmod(F.xxhash64("id", F.lit(77)), F.lit(every)) == 0).select("v").limit(4 * n).toArrow()
    return matrix(got.column("v"), "<f4", DIMS)


def by_range(df: DataFrame, parts: int, column: str | Column = "part") -> DataFrame:
    """Rows of range p to partition p."""
    return df.repartitionById(parts, F.col(column) if isinstance(column, str) else column)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of a partition as one table."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None
