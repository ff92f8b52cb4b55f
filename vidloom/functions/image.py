"""Image geometry and perceptual hashes of decoded frames, in NumPy.

Frames are ``height x width x channels`` arrays of bytes. As columns they are
binary with their size, handled in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as St


def grey(frame: np.ndarray) -> np.ndarray:
    """Luma of an RGB frame; a grey frame as it is."""
    f = np.asarray(frame, dtype=np.float64)
    return f if f.ndim == 2 else f[..., :3] @ np.array([0.299, 0.587, 0.114])


def to_bgr(frame: np.ndarray) -> np.ndarray:
    """Grey, RGB or RGBA as BGR; anything else is an error."""
    f = np.asarray(frame)
    if f.ndim == 2:
        return np.repeat(f[..., None], 3, axis=2)
    if f.ndim == 3 and f.shape[2] in (3, 4):
        return f[..., 2::-1]
    raise ValueError(f"not an image: shape {f.shape}")


def black_borders(frame: np.ndarray, threshold: float = 16, min_ratio: float = 0.02) -> tuple[int, int, int, int]:
    """``top, bottom, left, right`` of what isn't black; thin borders and all-black frames stay whole."""
    lit = np.round(grey(frame)) > threshold
    h, w = lit.shape
    rows, cols = np.flatnonzero(lit.any(axis=1)), np.flatnonzero(lit.any(axis=0))
    if not len(rows):
        return 0, h, 0, w
    top, bottom, left, right = rows[0], h - 1 - rows[-1], cols[0], w - 1 - cols[-1]
    ver, hor = max(1, int(h * min_ratio)), max(1, int(w * min_ratio))
    return int(top if top >= ver else 0), int(h - bottom if bottom >= ver else h), int(left if left >= hor else 0), int(w - right if right >= hor else w)


def crop_borders(frame: np.ndarray, threshold: float = 16, min_ratio: float = 0.02) -> np.ndarray:
    t, b, left, r = black_borders(frame, threshold, min_ratio)
    return np.asarray(frame)[t:b, left:r]


def rotate_portrait(frame: np.ndarray, rotation: str = "right_90") -> np.ndarray:
    """A frame that is higher than wide, turned by a quarter."""
    f = np.asarray(frame)
    if f.shape[0] <= f.shape[1] or rotation == "none":
        return f
    return np.rot90(f, 1 if rotation == "left_90" else -1)


def resize(frame: np.ndarray, height: int, width: int, area: bool = False) -> np.ndarray:
    """Resampled by box average (``area``, when shrinking) or bilinear interpolation."""
    f = np.asarray(frame, dtype=np.float64)
    if area and height <= f.shape[0] and width <= f.shape[1]:
        return _weights(f.shape[0], height) @ f if f.ndim == 1 else np.einsum("ij,jk...,lk->il...", _weights(f.shape[0], height), f, _weights(f.shape[1], width))
    y, x = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((height, f.shape[0]), (width, f.shape[1])))
    y, x = np.clip(y, 0, f.shape[0] - 1), np.clip(x, 0, f.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, f.shape[0] - 1), np.minimum(x0 + 1, f.shape[1] - 1)
    extra = (1,) * (f.ndim - 2)
    wy, wx = (y - y0).reshape(-1, 1, *extra), (x - x0).reshape(1, -1, *extra)
    top = f[np.ix_(y0, x0)] * (1 - wx) + f[np.ix_(y0, x1)] * wx
    low = f[np.ix_(y1, x0)] * (1 - wx) + f[np.ix_(y1, x1)] * wx
    return top * (1 - wy) + low * wy


def _weights(n: int, m: int) -> np.ndarray:
    """Rows of shares with which n cells fall into m equal boxes."""
    edges = np.arange(m + 1) * n / m
    lo, hi = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(0, hi - lo) * m / n


def fit(frame: np.ndarray, size: int, mode: str = "center_crop", area: bool = False) -> np.ndarray:
    """A square of ``size``: the middle of the frame, or all of it with black bars (``letterbox``)."""
    f = np.asarray(frame)
    h, w = f.shape[:2]
    if not h or not w:
        return np.zeros((size, size, *f.shape[2:]))
    scale = size / (min(h, w) if mode == "center_crop" else max(h, w))
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    r = resize(f, nh, nw, area)
    if mode == "center_crop":
        y, x = (nh - size) // 2, (nw - size) // 2
        return r[y : y + size, x : x + size]
    out = np.zeros((size, size, *f.shape[2:]))
    y, x = (size - nh) // 2, (size - nw) // 2
    out[y : y + nh, x : x + nw] = r
    return out


def preprocess(frame: np.ndarray, size: int = 224, mode: str = "center_crop", crop: bool = False, rotation: str = "none", area: bool = False) -> np.ndarray:
    """Borders cropped, portrait turned, size fitted; in this order."""
    f = crop_borders(frame) if crop else np.asarray(frame)
    return fit(rotate_portrait(f, rotation), size, mode, area)


def phash(frame: np.ndarray, side: int = 8, factor: int = 4) -> str:
    """64-bit perceptual hash as 16 hex digits: signs of low cosine frequencies against their median."""
    n = side * factor
    g = resize(grey(frame), n, n, area=min(np.asarray(frame).shape[:2]) >= n)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ g @ basis.T)[:side, :side]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{side * side // 4}x}"


def frame_features(frame: np.ndarray, side: int = 32) -> np.ndarray:
    """Strided grey thumbnail as a unit vector, for choosing diverse frames."""
    g = grey(frame)
    v = g[:: max(1, g.shape[0] // side), :: max(1, g.shape[1] // side)].ravel()
    n = np.sqrt(v @ v)
    return (v / n if n else v).astype(np.float32)


def _decode(data: bytes, height: int, width: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    channels = len(a) // (height * width)
    return a.reshape(height, width) if channels == 1 else a.reshape(height, width, channels)


@F.pandas_udf(St.StringType())
def phash_of(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Hash of raw pixels; null where there are none."""
    return pd.Series([phash(_decode(p, h, w)) if p is not None and h and w else None for p, h, w in zip(pixels, height, width)])


@F.pandas_udf(St.ArrayType(St.FloatType()))
def embedding_of(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Deterministic 64-number feature vector of raw pixels: low cosine frequencies of the fitted frame, unit length."""

    def one(p: bytes, h: int, w: int) -> list[float] | None:
        if p is None or not h or not w:
            return None
        g = fit(grey(_decode(p, h, w)), 32)
        k = np.arange(32)
        basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
        v = (basis @ g @ basis.T)[:8, :8].ravel()
        n = np.sqrt(v @ v)
        return [float(x) for x in (v / n if n else v)]

    return pd.Series([one(p, h, w) for p, h, w in zip(pixels, height, width)])


def hash_similarity_text(a: Column, b: Column) -> Column:
    """Similarity of two hex hashes."""
    from .vectors import hash_long, hash_similarity

    return hash_similarity(hash_long(a), hash_long(b))
