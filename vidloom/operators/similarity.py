"""Top-k similarity joins of the frames of two videos, and what follows from them.

Frames of a video are packed into blocks, one row per block with its positions and
vectors as bytes. The blocks of the first video of each pair are spread over the
tasks by a hash and stay there; a block of the second video goes once to every task
that holds a partner of it, and passes through as a stream. So a video with a large
share of all frames is many blocks, no task holds it whole, and the best k of each
source frame are merged over the blocks of the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St
from pyspark.sql.window import Window as W

from ..session import Scratch
from . import sorted_arrays as A

BLOCK = 1024
#: Bytes of vectors that one task of a similarity join holds; as many tasks as that takes.
TASK_BYTES = 64_000_000


def frame_blocks(frames: DataFrame, video: str = "video_id", pos: str = "frame_pos", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per block of a video: ``video``, ``block``, ``n``, ``dims``, and as bytes ``pos`` (ascending) and ``v``.

    Rows with a null video, position or vector, or an empty vector, are left out. Vectors of one block must have one
    length. Numbers keep their precision (4 bytes of a float, else 8).
    """
    item = frames.schema[vector].dataType.elementType
    real = "float" if isinstance(item, St.FloatType) else "double"
    kind, number = ("<f4", pa.float32()) if real == "float" else ("<f8", pa.float64())
    f = frames.select(F.col(video).alias("video"), F.floor(F.col(pos) / block).cast("long").alias("block"), F.col(pos).cast("long").alias("pos"), F.col(vector).cast(f"array<{real}>").alias("v"))
    f = f.where("video is not null and pos is not null and size(v) > 0")
    name = f.schema["video"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, vs, owner = None, [], [], None

        def full() -> pa.RecordBatch:
            e, p = np.concatenate(vs), np.concatenate(at)
            arrays = [owner, pa.array([key[1]], pa.int64()), pa.array([len(p)], pa.int32()), pa.array([e.shape[1]], pa.int32()), pa.array([p.astype("<i8").tobytes()], pa.binary()), pa.array([e.astype(kind).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["video", "block", "n", "dims", "pos", "v"])

        for x in batches:
            if not x.num_rows:
                continue
            names, blocks = x.column("video").to_pylist(), x.column("block").to_pylist()
            first = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1] or blocks[i] != blocks[i - 1]]
            for a, z in zip(first, [*first[1:], len(names)]):
                if (names[a], blocks[a]) != key:
                    if key is not None:
                        yield full()
                    key, at, vs, owner = (names[a], blocks[a]), [], [], x.column("video").slice(a, 1)
                rows = x.column("v").slice(a, z - a)
                flat = rows.flatten().cast(number).to_numpy(zero_copy_only=False)
                sizes = np.diff(rows.offsets.to_numpy())
                if len(set(sizes.tolist())) > 1 or (vs and vs[0].shape[1] != sizes[0]):
                    raise ValueError("vectors of different lengths can't be compared")
                at.append(x.column("pos").slice(a, z - a).to_numpy())
                vs.append(flat.reshape(z - a, -1))
        if key is not None:
            yield full()

    placed = f.repartition("video", "block").sortWithinPartitions("video", "block", "pos")
    return placed.mapInArrow(pack, f"video {name}, block bigint, n int, dims int, pos binary, v binary")


def all_pairs(videos: DataFrame, video: str = "video_id") -> DataFrame:
    """Every unordered pair of distinct videos, ``a`` before ``b`` in key order.

    Quadratic by definition; for large collections use the candidate operator instead.
    """
    v = videos.select(F.col(video).alias("a")).where("a is not null").distinct()
    return v.join(v.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


def top_of_rows(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest values of each row; of equal ones the first columns."""
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        r, c = np.nonzero(s >= kth[:, None])
    else:
        r, c = np.nonzero(np.ones(s.shape, bool))
    order = np.lexsort((c, -s[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def pair_similarities(blocks: DataFrame, pairs: DataFrame, k: int, digits: int = 6, least: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``a``, ``b``, ``direction``, ``src``, ``tgt``, ``sim``, ``rank``: the best ``k`` targets of each frame in both directions.

    ``pairs`` has ``a`` and ``b``, and may have a ``direction``: then only that one is computed. Similarities are rounded
    to ``digits`` before they are ranked, ties go to the earlier target frame. Per block pair at most k targets of a
    frame leave the task; with ``least`` only those that reach it, and the best one of the block in any case. Vectors of
    different lengths can't be compared: an error, as in a plain matrix product.
    """
    spark = blocks.sparkSession
    if not hasattr(blocks, "_vidloom_path"):
        blocks = (scratch or Scratch(spark, "blocks")).table(blocks, "blocks")
    way = F.col("direction") if "direction" in pairs.columns else F.lit(None).cast("string").alias("direction")
    p = pairs.select("a", "b", way).distinct()
    name = p.schema["a"].dataType.simpleString()
    size = blocks.agg(F.sum(F.octet_length("v")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, min(size["n"], max(2 * spark.sparkContext.defaultParallelism, -(-(size["s"] or 0) // TASK_BYTES))))
    part = F.pmod(F.xxhash64("video", "block"), F.lit(parts)).cast("int")
    home = blocks.select("video", part.alias("part")).distinct()
    wanted = p.join(home, F.col("a") == F.col("video")).select("part", "a", "b", "direction")
    null = lambda *c: [F.lit(None).cast(t).alias(n) for n, t in c]
    body = (("block", "bigint"), ("n", "int"), ("dims", "int"), ("pos", "binary"), ("v", "binary"))
    plan = wanted.select("part", F.lit(0).alias("kind"), F.col("a").alias("video"), F.col("b").alias("other"), "direction", *null(*body)).distinct()
    names = [n for n, _ in body]
    held = blocks.join(p.select(F.col("a").alias("video")).distinct(), "video", "left_semi").select(part.alias("part"), F.lit(1).alias("kind"), "video", *null(("other", name), ("direction", "string")), *names)
    sent = blocks.join(wanted.select("part", F.col("b").alias("video")).distinct(), "video").select("part", F.lit(2).alias("kind"), "video", *null(("other", name), ("direction", "string")), *names)

    def unit(v: bytes, n: int, dims: int) -> np.ndarray:
        e = np.frombuffer(v, "<f4" if len(v) == 4 * n * dims else "<f8").reshape(n, dims).astype(np.float64)
        m = np.sqrt((e * e).sum(axis=1, keepdims=True))
        return e / np.where(m > 0, m, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners: dict = {}
        mine: dict = {}
        for x in batches:
            kind_of = x.column("video").type
            for kind, video, other, direction, n, dims, pos, v in zip(*(x.column(c).to_pylist() for c in ("kind", "video", "other", "direction", "n", "dims", "pos", "v"))):
                if kind == 0:
                    partners.setdefault(other, []).append((video, direction))
                elif kind == 1:
                    mine.setdefault(video, []).append((np.frombuffer(pos, "<i8"), unit(v, n, dims)))
                else:
                    pt, y = np.frombuffer(pos, "<i8"), unit(v, n, dims)
                    for a, only in partners.get(video, ()):
                        for ps, u in mine.get(a, ()):
                            s = np.round(u @ y.T, digits) + 0.0
                            for d, m, qs, qt in (("A_to_B", s, ps, pt), ("B_to_A", s.T, pt, ps)):
                                if only is not None and only != d:
                                    continue
                                r, c = top_of_rows(m, k)
                                sim = m[r, c]
                                if least is not None:
                                    ok = (sim >= least) | (np.diff(r, prepend=-1) > 0)
                                    r, c, sim = r[ok], c[ok], sim[ok]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.repeat(pa.scalar(a, kind_of), len(r)), pa.repeat(pa.scalar(video, kind_of), len(r)), pa.repeat(d, len(r)), pa.array(qs[r]), pa.array(qt[c]), pa.array(sim)],
                                    names=["a", "b", "direction", "src", "tgt", "sim"],
                                )

    both = A.by_range(plan.unionByName(held).unionByName(sent), parts).sortWithinPartitions("kind")
    near = both.mapInArrow(run, f"a {name}, b {name}, direction string, src bigint, tgt bigint, sim double")
    best = W.partitionBy("a", "b", "direction", "src").orderBy(F.desc("sim"), "tgt")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def early_stopped_similarities(blocks: DataFrame, pairs: DataFrame, k: int, threshold: float, margin: float = 0.04, least: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """As ``pair_similarities``, but a pair that shows nothing in the direction of its smaller side is done with that.

    The side with fewer frames (``a`` if equal) looks first. Where none of its frames has a match and the 99th percentile
    of its best similarities stays ``margin`` below the threshold, the other direction isn't computed.
    """
    scratch = scratch or Scratch(blocks.sparkSession, "early")
    if not hasattr(blocks, "_vidloom_path"):
        blocks = scratch.table(blocks, "blocks")
    sizes = blocks.groupBy("video").agg(F.sum("n").alias("n"))
    p = pairs.select("a", "b").distinct()
    p = p.join(sizes.select(F.col("video").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("video").alias("b"), F.col("n").alias("nb")), "b")
    p = scratch.table(p.select("a", "b", F.when(F.col("na") <= F.col("nb"), "A_to_B").otherwise("B_to_A").alias("direction")), "directed")
    first = scratch.table(pair_similarities(blocks, p, k, least=least, scratch=scratch), "first")
    best = F.greatest(F.col("sim"), F.lit(0.0))
    seen = first.where("rank = 1").groupBy("a", "b").agg(F.max(best).alias("top"), F.percentile(best, F.lit(0.99)).alias("p"))
    stop = seen.where((F.col("top") < threshold) & (F.col("p") < max(0.0, threshold - max(0.0, margin))))
    rest = p.join(stop, ["a", "b"], "left_anti").select("a", "b", F.when(F.col("direction") == "A_to_B", "B_to_A").otherwise("A_to_B").alias("direction"))
    return first.unionByName(pair_similarities(blocks, rest, k, least=least, scratch=scratch))


def top_k_join(blocks: DataFrame, pairs: DataFrame, k: int = 10, threshold: float = 0.65) -> DataFrame:
    """Matches at or above ``threshold`` among the best ``k`` targets of every source frame, both directions."""
    return pair_similarities(blocks, pairs, k, least=threshold).where(F.col("sim") >= threshold)


def best_match_stats(similarities: DataFrame, threshold: float) -> DataFrame:
    """Per pair and direction: frames with a match, mean of the best similarities at or above the threshold.

    The best similarity of a frame counts as 0 if it is negative.
    """
    best = similarities.where("rank = 1").withColumn("best", F.greatest(F.col("sim"), F.lit(0.0)))
    hit = F.when(F.col("best") >= threshold, F.col("best"))
    return best.groupBy("a", "b", "direction").agg(F.count(hit).alias("matched_frames"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("avg_similarity"))


def raw_stats(similarities: DataFrame) -> DataFrame:
    """Per pair maximum, mean, 95th and 99th percentile of the best similarities of the directions that were computed."""
    best = similarities.where("rank = 1").withColumn("best", F.greatest(F.col("sim"), F.lit(0.0)))
    return best.groupBy("a", "b").agg(
        F.max("best").alias("raw_max"), F.avg("best").alias("raw_mean"), F.percentile("best", F.lit(0.95)).alias("raw_p95"), F.percentile("best", F.lit(0.99)).alias("raw_p99")
    )


def search_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", digits: int = 6, block: int = 4096) -> DataFrame:
    """``query``, ``rank``, ``key``, ``similarity``: for every row of ``queries`` its ``k`` most similar ``vectors``.

    Both have ``key`` and ``vector``. A query may be one of the vectors; it then finds itself. The queries are held in
    blocks, every block of them meets every part of the vectors in a task of its own, and the best k of each part are
    merged. Ties go to the smaller key. Null keys and empty vectors don't take part; a zero vector is unlike any other;
    only vectors of the length of the query are compared with it.
    """
    from .candidates import nearest

    def shaped(d: DataFrame, key_name: str, owner: str) -> DataFrame:
        return d.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias(key_name), F.lit(owner).alias("owner"), F.col(vector).cast("array<double>").alias("vector"))

    found = nearest(shaped(queries, "id", "q").distinct(), shaped(vectors, "id", "v").distinct(), k, digits, block)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("sim"), "tgt"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", F.col("tgt").alias(key), F.col("sim").alias("similarity"))


def embedding_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Count, dimension, and mean, population deviation, minimum and maximum of the norms."""
    from ..functions.vectors import norm

    n = vectors.where(F.size(vector) > 0).select(F.size(vector).alias("d"), norm(vector).alias("n"))
    return n.agg(
        F.count(F.lit(1)).alias("num_embeddings"), F.max("d").alias("embedding_dim"), F.avg("n").alias("mean_norm"), F.stddev_pop("n").alias("std_norm"), F.min("n").alias("min_norm"), F.max("n").alias("max_norm")
    )


def mean_vector(frames: DataFrame, keys: list[str], vector: str = "embedding", normalize: bool = True) -> DataFrame:
    """Element-wise mean of the vectors of each group, scaled to length 1 unless it is zero.

    Sums are made in each Arrow batch before the shuffle, so a group of any size costs one row per batch. Null keys form a
    group, null and empty vectors don't count; vectors of different lengths in a group are an error.
    """
    from ..functions.vectors import l2_normalize

    f = frames.where(F.size(vector) > 0).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.lit(1).cast("long").alias("n"), F.col(vector).cast("array<double>").alias("v"))
    names = [f"k{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n} {f.schema[n].dataType.simpleString()}" for n in names)

    def added(x: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
        import pandas as pd

        x = (pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x).combine_chunks()
        group = pd.DataFrame({c: x.column(c).to_pandas() for c in names}).groupby(names, dropna=False, sort=False).ngroup().to_numpy()
        v = x.column("v").combine_chunks()
        if isinstance(v, pa.ChunkedArray):
            v = pa.concat_arrays(v.chunks)
        sizes = np.diff(v.offsets.to_numpy())
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        heads = order[first]
        if (sizes[order] != np.repeat(sizes[heads], np.diff(np.append(first, len(order))))).any():
            raise ValueError("vectors of different lengths have no mean")
        n = np.add.reduceat(x.column("n").to_numpy()[order], first)
        flat, at = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        sums = []
        for size in np.unique(sizes[heads]):
            pick = np.flatnonzero(sizes[order] == size)
            m = flat[at[order[pick]][:, None] + np.arange(size)]
            starts = np.flatnonzero(np.diff(group[order[pick]], prepend=-1))
            sums += list(zip(group[order[pick[starts]]], np.add.reduceat(m, starts, axis=0)))
        by_group = dict(sums)
        take = pa.array(heads)
        lists = pa.array([by_group[g] for g in group[heads]], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*[x.column(c).take(take).combine_chunks() for c in names], pa.array(n), lists], names=[*names, "n", "v"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield added(x)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in batches:  # sorted by key: only the last group of a batch may go on in the next one
            if not x.num_rows:
                continue
            held = added(x if held is None else pa.Table.from_batches([held, x]))
            if held.num_rows > 1:
                yield held.slice(0, held.num_rows - 1)
                held = pa.RecordBatch.from_arrays([c.take(pa.array([held.num_rows - 1])) for c in held.columns], names=held.schema.names)
        if held is not None:
            yield held

    sums = f.mapInArrow(part, f"{kinds}, n bigint, v array<double>").repartition(*names).sortWithinPartitions(*names).mapInArrow(total, f"{kinds}, n bigint, v array<double>")
    out = sums.select(*[F.col(n).alias(c) for n, c in zip(names, keys)], F.transform("v", lambda x: x / F.col("n")).alias("mean_vector"))
    return out.withColumn("mean_vector", l2_normalize("mean_vector")) if normalize else out


def diversity(frames: DataFrame, video: str = "video_id", vector: str = "embedding") -> DataFrame:
    """Mean cosine of the different pairs of frames of each video, from the sum of its unit vectors.

    The sum of all products of unit vectors is the squared length of their sum, so no pairs are formed. Null for
    a video of one frame.
    """
    from ..functions.vectors import dot, l2_normalize

    unit = frames.where(F.size(vector) > 0).select(F.col(video).alias("video_id"), l2_normalize(vector).alias("u"))
    n = unit.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum(dot("u", "u")).alias("own"))
    total = mean_vector(unit, ["video_id"], "u", normalize=False)
    x = total.join(n, "video_id")
    square = dot("mean_vector", "mean_vector") * F.col("n") * F.col("n")
    return x.select("video_id", "n", F.when(F.col("n") > 1, (square - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("mean_similarity"))
