"""Which frames of a video are kept.

The dynamic sampler compares a frame with the last one it kept, so it is a fold
with constant state: a stream over sorted partitions, not a window with lag.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def step_filter(frames: DataFrame, step: int, index: str = "frame_index") -> DataFrame:
    """Every ``step``-th frame, by its index."""
    return frames.where(F.col(index) % max(1, step) == 0)


def keep_frame(state: tuple[int, int] | None, index: int, bits: int, max_gap: int, skip: float) -> bool:
    """First frame, frame far enough from the last kept one, or one that differs enough from it."""
    if state is None or index - state[0] >= max_gap:
        return True
    return 1 - ((state[1] ^ bits) & 0xFFFFFFFFFFFFFFFF).bit_count() / 64 < skip


def dynamic_sample(frames: DataFrame, video: str, index: str, bits: str, max_gap: str, skip: float = 0.90) -> DataFrame:
    """The kept rows of ``frames``, all columns.

    ``bits`` holds the 64-bit hash of a frame, ``max_gap`` the longest gap in frames of its video (at least 1 counts).
    Rows with a null video, index or hash are left out; equal indexes are taken in order of their hash. A frame that is
    ``max_gap`` or more after the one before it is kept whatever came earlier, so the fold starts afresh there and a
    video falls into independent runs; the longest run bounds the time of a task, and its memory is one hash and index.
    """
    rows = frames.where(F.col(video).isNotNull() & F.col(index).isNotNull() & F.col(bits).isNotNull())
    columns = rows.columns
    gap = F.greatest(F.lit(1), F.coalesce(F.col(max_gap), F.lit(1)))
    rows = running(rows, [video], [index, bits], before={"__before": F.col(index)})
    rows = rows.withColumn("__new", F.coalesce(F.col(index) - F.col("__before") >= gap, F.lit(True)))
    # A run is named by the index at which it starts.
    rows = running(rows.drop("__before"), [video], [index, bits], tops={"__run": F.when(F.col("__new"), F.col(index))})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = object(), None
        for x in batches:
            kept = np.zeros(len(x), bool)
            for i, (v, run, at, h, most) in enumerate(zip(x[video], x["__run"].to_numpy(), x[index].to_numpy(), x[bits].to_numpy(), x[max_gap].to_numpy())):
                if (v, run) != name:
                    name, state = (v, run), None
                if keep_frame(state, int(at), int(h), max(1, int(most)) if most == most else 1, skip):
                    state, kept[i] = (int(at), int(h)), True
            yield x[kept][columns]

    return rows.drop("__new").repartition(video, "__run").sortWithinPartitions(video, "__run", index, bits).mapInPandas(fold, frames.schema)


def farthest_points(vectors: np.ndarray, count: int) -> np.ndarray:
    """Positions of ``count`` vectors, each least similar to those before it, in order of position."""
    n = len(vectors)
    if n <= count:
        return np.arange(n)
    u = vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-30)
    picked, closest = [0], u @ u[0]
    closest[0] = np.inf
    while len(picked) < count:
        k = int(np.argmin(closest))
        picked.append(k)
        closest = np.maximum(closest, u @ u[k])
        closest[k] = np.inf
    return np.sort(np.array(picked))


def diverse_sample(frames: DataFrame, count: int = 16, pool: int = 64, video: str = "video_id", pos: str = "frame_pos", vector: str = "embedding") -> DataFrame:
    """``video``, ``pos`` of ``count`` mutually dissimilar frames out of ``pool`` evenly spaced ones of each video."""
    from .candidates import even_sample

    cut = even_sample(frames.where(F.size(vector) > 0), max(count, pool), video, pos)
    lists = cut.groupBy(video).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(vector).cast("array<double>").alias("v")))).alias("items"))  # at most pool items

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for v, items in zip(x[video], x["items"]):
                k = farthest_points(np.stack([np.asarray(i["v"]) for i in items]), count)
                yield pd.DataFrame({video: [v] * len(k), pos: [items[i]["p"] for i in k]})

    kind = frames.schema[video].dataType.simpleString()
    return lists.mapInPandas(run, f"{video} {kind}, {pos} bigint")
