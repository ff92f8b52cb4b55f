"""Embedding of frames with a pluggable embedder, reusing the cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import mean_vector

Embedder = Callable[[list[np.ndarray]], np.ndarray]
_loaded: dict[str, Embedder] = {}


def cosine_embedder() -> Embedder:
    """Deterministic embedder: low cosine frequencies of the grey frame, 64 numbers, unit length."""
    from ..functions.image import fit, grey

    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)

    def embed(frames: list[np.ndarray]) -> np.ndarray:
        if not frames:
            return np.zeros((0, 64), np.float32)
        v = np.stack([(basis @ fit(grey(f), 32) @ basis.T)[:8, :8].ravel() for f in frames])
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return (v / np.where(n > 0, n, 1)).astype(np.float32)

    return embed


def worker_embedder(name: str, make: Callable[[], Embedder]) -> Embedder:
    """The embedder of this Python worker, made once."""
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


def embed_frames(frames: DataFrame, make: Callable[[], Embedder] = cosine_embedder, batch: int = 32, name: str = "default") -> DataFrame:
    """``frames`` (``pixels``, ``height``, ``width`` and others) with ``embedding`` instead of the pixels.

    Frames without pixels have a null embedding. An embedder is made once per Python worker and gets batches.
    """
    kept = [c for c in frames.columns if c != "pixels"]
    schema = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in kept) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.image import _decode

        embed = worker_embedder(name, make)
        for x in batches:
            out: list = [None] * len(x)
            good = [i for i, (p, h, w) in enumerate(zip(x["pixels"], x["height"], x["width"])) if p is not None and h > 0 and w > 0]
            for a in range(0, len(good), batch):
                part = good[a : a + batch]
                for i, v in zip(part, embed([_decode(x["pixels"].iloc[i], int(x["height"].iloc[i]), int(x["width"].iloc[i])) for i in part])):
                    out[i] = v
            yield x[kept].assign(embedding=out)

    return frames.mapInPandas(run, schema)


def embed_missing(frames: DataFrame, cached: DataFrame, make: Callable[[], Embedder] = cosine_embedder, by: str = "video_path") -> DataFrame:
    """Cached frames, and embedded ones of the videos that the cache doesn't hold."""
    todo = frames.join(cached.select(by).distinct(), by, "left_anti")
    return cached.unionByName(embed_frames(todo, make).select(*cached.columns))


def video_vectors(frames: DataFrame, count: int = 16, video: str = "video_id", pos: str = "frame_pos", vector: str = "embedding") -> DataFrame:
    """Unit mean vector of up to ``count`` evenly spaced frames of each video."""
    from .candidates import even_sample

    return mean_vector(even_sample(frames.where(F.size(vector) > 0), count, video, pos), [video], vector)


def build_index(frames: DataFrame, path: str | None = None, make: Callable[[], Embedder] = cosine_embedder, count: int = 16, by: str = "video_path", pos: str = "frame_pos") -> DataFrame:
    """``name``, ``vector``: one vector for each video of ``frames`` (``by``, ``pos``, ``pixels``, ``height``, ``width``), written to ``path`` if given.

    Only the evenly spaced frames that count are embedded. Without frames the index is empty.
    """
    from ..functions import text as T
    from ..sources.caches import write_index
    from .candidates import even_sample

    good = frames.where(F.col("pixels").isNotNull() & (F.col("height") > 0) & (F.col("width") > 0))
    vectors = mean_vector(embed_frames(even_sample(good, count, by, pos), make), [by])
    out = vectors.select(T.basename(by).alias("name"), F.col("mean_vector").alias("vector")).orderBy("name")
    if path:
        write_index(out, path)
    return out


# Batch sizes by device and edge length of the input.
def batch_size(device: str, input_size: int = 224, override: str | int | None = None) -> int:
    """How many frames an embedder gets at once; a readable override wins."""
    try:
        if override is not None and str(override).strip():
            return max(1, int(override))
    except ValueError:
        pass
    if device.lower().startswith("cuda"):
        return 2 if input_size >= 512 else 4 if input_size >= 336 else 8
    return 16 if input_size >= 384 else 32


def model_source(roots: list[str], name: str, needed: tuple[str, ...], hub_id: str, hub_folder: str | None = None) -> str:
    """Where an embedding model lies: the first complete folder below the roots, else the id under which a hub has it.

    A root may be the model's folder, hold it under ``name``, or hold a hub cache (``hub_folder``): there the snapshot that
    ``refs/main`` names counts, else the newest complete one. A folder is complete if it has ``needed``; a name with ``|``
    needs one of its alternatives. Equal roots count once.
    """
    from pathlib import Path

    def complete(p: Path) -> bool:
        return p.is_dir() and all(any((p / x).is_file() for x in n.split("|")) for n in needed)

    for root in dict.fromkeys(Path(r).expanduser().resolve() for r in roots if r):
        for p in dict.fromkeys((root, root if root.name == name else root / name)):
            if complete(p):
                return str(p)
        cache = root if root.name == hub_folder else root / hub_folder if hub_folder else None
        if cache is None or not (cache / "snapshots").is_dir():
            continue
        ref = cache / "refs" / "main"
        main = cache / "snapshots" / ref.read_text().strip() if ref.is_file() else None
        if main is not None and complete(main):
            return str(main)
        rest = sorted((p for p in (cache / "snapshots").iterdir() if complete(p)), key=lambda p: (p.stat().st_mtime, p.name))
        if rest:
            return str(rest[-1])
    return hub_id


def as_images(frames: DataFrame, origin: str = "video_path") -> DataFrame:
    """``frames`` with ``image`` instead of the pixels: the struct of Spark's image source (blue first), null without pixels."""
    kept = [c for c in frames.columns if c not in ("pixels", "height", "width")]

    @F.pandas_udf("binary")
    def swapped(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda p: None if p is None else np.frombuffer(p, np.uint8).reshape(-1, 3)[:, ::-1].tobytes())

    # 16: three channels of 8 bits, as the image source calls it.
    image = F.struct(F.col(origin).cast("string").alias("origin"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), swapped("pixels").alias("data"))
    return frames.select(*kept, F.when(F.col("pixels").isNotNull(), image).alias("image"))
