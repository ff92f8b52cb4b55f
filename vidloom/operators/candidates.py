"""Candidate pairs: which videos are worth a full comparison.

Every video asks with a bounded number of vectors (evenly spaced frames and pooled
windows) for its nearest vectors among a bounded number per video, so the work
depends on the number of videos, not of frames. ``exact`` compares every query with
every vector at every size: a task holds a block of queries with their best so far,
and the vectors pass through it tile by tile. ``forest`` is the approximate form, for
collections whose square is too much: it looks at the neighbours in sorted arrays of
hash strings, so that its work grows in proportion to the number of videos. Which of
them is used is the caller's choice, never the size's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Scratch, rows_of
from . import sorted_arrays as A
from .similarity import all_pairs, mean_vector, top_of_rows

#: Queries that a task of ``exact`` holds, with their best vectors so far.
QUERY_BLOCK = 8_192
#: Cells of a tile: queries times vectors that are compared at once.
TILE = 4_000_000


def even_positions(counts: DataFrame, limit: int, video: str = "video_id", n: str = "n") -> DataFrame:
    """``video``, ``pos``: at most ``limit`` evenly spaced positions of each video, first and last included."""
    c = F.least(F.lit(max(1, limit)).cast("long"), F.col(n).cast("long"))
    i = counts.where(F.col(n) > 0).select(video, n, c.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), c - 1)).alias("i"))
    pos = F.when(F.col("c") > 1, F.floor(F.col("i") * (F.col(n) - 1) / (F.col("c") - 1))).otherwise(0)
    return i.select(video, pos.cast("long").alias("pos")).distinct()


def even_sample(frames: DataFrame, limit: int, video: str = "video_id", pos: str = "frame_pos") -> DataFrame:
    """Evenly spaced rows of each video; ``pos`` numbers its rows from 0 without gaps."""
    picked = even_positions(frames.groupBy(video).agg(F.count(F.lit(1)).alias("n")), limit, video)
    return frames.join(picked.withColumnRenamed("pos", pos), [video, pos])


def window_vectors(frames: DataFrame, seconds: float = 30.0, limit: int = 96) -> DataFrame:
    """``video_id``, ``item``, ``vector``: normalised mean vector of each time window, evenly sampled."""
    bucket = F.floor(F.greatest(F.lit(0.0), F.col("ts")) / max(seconds, 1.0))
    pooled = mean_vector(frames.withColumn("bucket", bucket), ["video_id", "bucket"])
    order = W.partitionBy("video_id").orderBy("bucket")
    numbered = pooled.withColumn("frame_pos", (F.row_number().over(order) - 1).cast("long"))
    return even_sample(numbered, limit).select("video_id", F.concat(F.lit("w"), F.col("frame_pos").cast("string")).alias("item"), F.col("mean_vector").alias("vector"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists of a column and their numbers one after another."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _unit(e: np.ndarray) -> np.ndarray:
    m = np.sqrt((e * e).sum(axis=1, keepdims=True))
    return e / np.where(m > 0, m, 1.0)


class _Best:
    """The best ``k`` vectors of each of some queries, while vectors pass in order of their identifier."""

    def __init__(self, u: np.ndarray, k: int, digits: int):
        self.u, self.k, self.digits = u, k, digits
        self.r, self.s = np.zeros(0, np.int64), np.zeros(0)
        self.ids, self.owners = np.zeros(0, object), np.zeros(0, object)
        self.kth = np.full(len(u), -np.inf)

    def see(self, x: np.ndarray, ids: np.ndarray, owners: np.ndarray) -> None:
        step = max(1, TILE // max(1, len(x)))
        rs, cs, ss = [], [], []
        for a in range(0, len(self.u), step):
            s = np.round(self.u[a : a + step] @ x.T, self.digits) + 0.0
            better = s > self.kth[a : a + step, None]  # a later vector that ties comes after those that are there
            if better.sum() > 4 * self.k * len(s):
                r, c = top_of_rows(s, self.k)
                ok = better[r, c]
                r, c = r[ok], c[ok]
            else:
                r, c = np.nonzero(better)
            rs.append(r + a)
            cs.append(c)
            ss.append(s[r, c])
        r, c = np.concatenate(rs), np.concatenate(cs)
        if not len(r):
            return
        every = np.concatenate([self.r, r])
        s = np.concatenate([self.s, *ss])
        came = np.concatenate([np.full(len(self.r), -1), c])
        order = np.lexsort((came, -s, every))  # stable: those that were there stay in their order
        rank = np.arange(len(order)) - np.searchsorted(every[order], every[order])
        order = order[rank < self.k]
        self.ids, self.owners = np.concatenate([self.ids, ids[c]])[order], np.concatenate([self.owners, owners[c]])[order]
        self.r, self.s = every[order], s[order]
        n = np.bincount(self.r, minlength=len(self.u))
        full = np.flatnonzero(n == self.k)
        self.kth[full] = self.s[np.cumsum(n)[full] - 1]


def nearest(asks: DataFrame, index: DataFrame, k: int, digits: int = 6, block: int | None = None) -> DataFrame:
    """``query``, ``src``, ``tgt``, ``owner``, ``sim``: for every query the best ``k`` vectors of the index.

    Both have ``id``, ``owner`` and ``vector`` (array of doubles); ``src`` is the owner of the query, ``owner`` that of
    the vector. Ties go to the smaller ``id``. Every block of queries meets every part of the index in a task of its own,
    that holds the queries only: the index passes in tiles. Vectors of another length than a query aren't compared with it.
    """
    parallel = 2 * asks.sparkSession.sparkContext.defaultParallelism
    n_asks, n_index = rows_of(asks), rows_of(index)
    # Every query block takes the whole index, every index part gives k rows a query: as many of each as move least.
    wide = 8 * (asks.select(F.size("vector")).first() or [1])[0]
    balanced = round((n_asks * k * 64 * parallel / max(1, n_index * wide)) ** 0.5)
    nq = max(1, -(-n_asks // (block or QUERY_BLOCK)), min(balanced, parallel, -(-n_asks // 64)))
    nx = max(1, min(-(-parallel // nq), -(-n_index // 1024)))
    kinds = {c: index.schema[c].dataType.simpleString() for c in ("id", "owner")}
    ask_kinds = {c: asks.schema[c].dataType.simpleString() for c in ("id", "owner")}

    def placed(d: DataFrame, asking: bool, own: int, others: int) -> DataFrame:
        b = F.pmod(F.xxhash64("id", "owner"), F.lit(own))
        o = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("o")
        d = d.select("id", "owner", "vector", o).withColumn("part", (b * others + F.col("o") if asking else F.col("o") * own + b).cast("int"))
        null = {c: F.lit(None).cast((kinds if asking else ask_kinds)[c]) for c in ("id", "owner")}
        q, x = ({c: F.col(c) for c in null}, null) if asking else (null, {c: F.col(c) for c in null})
        return d.select("part", F.lit(0 if asking else 1).alias("turn"), q["id"].alias("qid"), q["owner"].alias("qowner"), x["id"].alias("xid"), x["owner"].alias("xowner"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        best: dict[int, tuple[_Best, pa.Array, pa.Array]] = {}
        types: dict = {}
        for b in batches:
            turn = b.column("turn").to_numpy()
            cut = int(np.searchsorted(turn, 1))
            types = {c: b.column(c).type for c in ("qid", "qowner", "xid", "xowner")}
            for part, asking in ((b.slice(0, cut), True), (b.slice(cut), False)):
                if not part.num_rows:
                    continue
                sizes, flat = _lists(part.column("vector"))
                at = np.concatenate([[0], np.cumsum(sizes)])
                for d in np.unique(sizes):
                    pick = np.flatnonzero(sizes == d)
                    e, take = _unit(flat[at[pick][:, None] + np.arange(d)]), pa.array(pick)
                    if asking:
                        waiting.setdefault(int(d), []).append((e, part.column("qid").take(take), part.column("qowner").take(take)))
                        continue
                    if d in waiting:
                        es, ids, owners = zip(*waiting.pop(d))
                        best[d] = (_Best(np.concatenate(es), k, digits), pa.concat_arrays(ids), pa.concat_arrays(owners))
                    if d in best:
                        best[d][0].see(e, *(part.column(c).take(take).to_numpy(zero_copy_only=False) for c in ("xid", "xowner")))
        for found, ids, owners in best.values():
            for a in range(0, len(found.r), 100_000):
                z = slice(a, a + 100_000)
                r = pa.array(found.r[z])
                arrays = [ids.take(r), owners.take(r), pa.array(found.ids[z].tolist(), types["xid"]), pa.array(found.owners[z].tolist(), types["xowner"]), pa.array(found.s[z])]
                yield pa.RecordBatch.from_arrays(arrays, names=["query", "src", "tgt", "owner", "sim"])

    both = A.by_range(placed(asks, True, nq, nx).unionAll(placed(index, False, nx, nq)), nq * nx).sortWithinPartitions("turn", "xid")
    found = both.drop("part").mapInArrow(run, f"query {ask_kinds['id']}, src {ask_kinds['owner']}, tgt {kinds['id']}, owner {kinds['owner']}, sim double")
    return found if nx == 1 else best_of(found, k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of every query; ties go to the smaller identifier."""
    rank = F.row_number().over(W.partitionBy("src", "query").orderBy(F.desc("sim"), "tgt"))
    return found.withColumn("__rn", rank).where(F.col("__rn") <= k).drop("__rn")


def nearest_by_forest(asks: DataFrame, index: DataFrame, k: int, trees: int = 12, window: int | None = None, digits: int = 6, rows_per_part: int = 60_000, seed: int = 23) -> DataFrame:
    """As ``nearest``, from the ``window`` neighbours on either side in each of several sorted arrays.

    By default a window is a hundredth of the index, at least 2,048 rows: the nearest among many that nearly tie are as
    hard to find in a large index as in a small one (recall in the README). Range borders come from a sample of at most
    4 * ``SAMPLE_ROWS`` vectors; every vector is in every array.
    """
    both = asks.withColumn("asks", F.lit(True)).withColumn("held", F.lit(False)).unionByName(index.withColumn("asks", F.lit(False)).withColumn("held", F.lit(True)))
    both = both.groupBy("id", "owner").agg(F.first("vector").alias("vector"), F.max("asks").alias("asks"), F.max("held").alias("held"))
    both = both.withColumn("uid", F.xxhash64("id", "owner"))
    rows = rows_of(index)
    every = max(1, rows // A.SAMPLE_ROWS)
    sample = index.where(F.pmod(F.xxhash64("id", "owner"), F.lit(every)) == 0).select("vector").limit(4 * A.SAMPLE_ROWS).toPandas()["vector"]
    first = np.stack([np.asarray(v, dtype=np.float32) for v in sample]) if len(sample) else np.zeros((0, 1), np.float32)
    dims = first.shape[1]
    h = A.planes(trees, A.BITS, dims, seed)
    window = window or max(2048, rows // 100)
    parts = max(1, rows // max(rows_per_part, 8 * window))
    edges = [A.borders(A.bit_strings(first, t), parts) for t in h]
    kinds = {c: asks.schema[c].dataType.simpleString() for c in ("id", "owner")}
    names = ["id", "owner", "asks", "held"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            sizes, flat = _lists(x.column("vector"))
            if (sizes != dims).any():
                raise ValueError("vectors of different lengths can't be compared")
            e = flat.reshape(-1, dims)
            u, v, uid = e.astype(np.float32), A.binary(_unit(e)), x.column("uid").to_numpy()
            for t in range(trees):
                keys = A.bit_strings(u, h[t])
                part = (A.range_of(keys, edges[t], uid) + t * parts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys), *[x.column(c) for c in names], v], names=["part", "key", *names, "v"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = A.whole(batches)
        if got is None:
            return
        ids, owners = (got.column(c).combine_chunks() for c in ("id", "owner"))
        ids, owners = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (ids, owners))
        e, flags = A.matrix(got.column("v"), "<f8", dims), [got.column(c).to_numpy().astype(bool) for c in ("held", "asks")]
        order = np.lexsort((np.arange(len(ids)), got.column("key").to_numpy()))
        held, asking = order[flags[0][order]], order[flags[1][order]]
        place = np.searchsorted(got.column("key").to_numpy()[held], got.column("key").to_numpy()[asking])
        for a in range(0, len(asking), 128):
            mine, p = asking[a : a + 128], place[a : a + 128]
            near = held[max(0, p[0] - window) : p[-1] + window]
            r, c = top_of_rows(np.round(e[mine] @ e[near].T, digits) + 0.0, k)
            q, t = mine[r], near[c]
            sim = np.round((e[q] * e[t]).sum(axis=1), digits)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), owners.take(pa.array(q)), ids.take(pa.array(t)), owners.take(pa.array(t)), pa.array(sim)], names=["query", "src", "tgt", "owner", "sim"])

    placed = A.by_range(both.mapInArrow(spread, f"part int, key bigint, id {kinds['id']}, owner {kinds['owner']}, asks boolean, held boolean, v binary"), parts * trees)
    return placed.mapInArrow(look, f"query {kinds['id']}, src {kinds['owner']}, tgt {kinds['id']}, owner {kinds['owner']}, sim double").dropDuplicates(["query", "src", "tgt", "owner"])


def asking_vectors(frames: DataFrame, representatives: int = 64, index_frames: int = 2048, window_seconds: float = 30.0, max_windows: int = 96) -> tuple[DataFrame, DataFrame]:
    """The vectors with which videos ask, and those among which they look: ``id`` (video and item), ``owner``, ``vector``."""
    frame_item = F.concat(F.lit("f"), F.col("frame_pos").cast("string")).alias("item")
    windows = window_vectors(frames, window_seconds, max(1, max_windows))

    def shaped(limit: int) -> DataFrame:
        v = even_sample(frames, limit).select("video_id", frame_item, F.col("embedding").alias("vector")).unionByName(windows)
        return v.select(F.concat_ws("|", F.col("video_id").cast("string"), "item").alias("id"), F.col("video_id").alias("owner"), "vector")

    return shaped(max(4, representatives)), shaped(max(representatives, index_frames))


def candidate_pairs(
    frames: DataFrame, limit: int, match_threshold: float, representatives: int = 64, index_frames: int = 2048, window_seconds: float = 30.0, max_windows: int = 96, digits: int = 6,
    method: str = "exact", trees: int = 12, window: int | None = None, block: int | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """``a``, ``b`` with ``a`` before ``b``: pairs of which one side is among the ``limit`` best targets of the other.

    ``frames``: ``video_id``, ``frame_pos`` (0, 1, ... per video), ``ts``, ``embedding``. A limit of 0, or one that
    leaves nothing to choose, gives all pairs. Ties go to the smaller video. Rows with null columns don't take part.
    ``exact`` compares all queries with all vectors at every size: its work grows with the square of the number of
    videos, its memory doesn't. ``forest`` may miss some of the nearest vectors of a query, as any approximate index
    does (recall in the README).
    """
    if method not in ("exact", "forest"):
        raise ValueError(f"unknown method {method}")
    scratch = scratch or Scratch(frames.sparkSession, "candidates")
    f = frames.select("video_id", F.col("frame_pos").cast("long").alias("frame_pos"), "ts", F.col("embedding").cast("array<double>").alias("embedding"))
    f = f.where("video_id is not null and frame_pos is not null and size(embedding) > 0")
    videos = f.select("video_id").distinct()
    n = videos.count()
    if n < 2 or limit <= 0 or limit >= n - 1:
        return all_pairs(videos)
    ask, index = (scratch.table(v, "vectors") for v in asking_vectors(f, representatives, index_frames, window_seconds, max_windows))
    coarse = max(0.35, min(0.90, match_threshold - 0.16))
    k = max(128, limit * 16)
    near = best_of(nearest_by_forest(ask, index, k, trees, window, digits), k) if method == "forest" else nearest(ask, index, k, digits, block)
    near = near.where("src <> owner")
    best = near.groupBy("src", F.col("owner").alias("tgt"), "query").agg(F.max("sim").alias("s")).where("s > 0")
    asked = ask.groupBy(F.col("owner").alias("video_id")).agg(F.count(F.lit(1)).alias("queries"))
    scored = best.groupBy("src", "tgt").agg(F.sort_array(F.collect_list("s"), asc=False).alias("scores")).join(asked, F.col("src") == F.col("video_id"))
    out = scratch.table(ranked_pairs(scored, limit, coarse, match_threshold), "pairs")
    scratch.drop(ask, index)
    return out


def candidate_score(scores: str, queries: str, coarse: float, strong: float):  # noqa: ANN201
    """Score of a target from the descending best similarities of the queries that found it; the others count as 0."""
    n, q = F.col(queries), F.col(scores)
    share = lambda t: F.size(F.filter(q, lambda x: x >= t)) / n
    top = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))
    mean = F.aggregate(F.slice(q, 1, top), F.lit(0.0), lambda acc, x: acc + x) / top
    return share(strong) * 2.0 + share(coarse) * 1.25 + mean + F.get(q, F.lit(0)) * 0.25


def ranked_pairs(scored: DataFrame, limit: int, coarse: float, strong: float) -> DataFrame:
    """The ``limit`` best targets of every source, as unordered pairs, each once."""
    s = scored.withColumn("score", F.round(candidate_score("scores", "queries", coarse, strong), 9))
    top = s.withColumn("place", F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "tgt"))).where(F.col("place") <= limit)
    return top.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
