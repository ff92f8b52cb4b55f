"""The k most similar vectors of every vector, by a hash-prefix forest.

Each tree is a sorted array of long hash strings (signs of projections on random
hyperplanes). A lookup descends in every tree to its longest-prefix match: its place
in the sorted array. Then all trees ascend together: the prefix that a candidate must
share with the row gets shorter by one bit in all trees at once, until the candidates
of all trees are as many as wanted. So a row takes few candidates from a tree in which
its prefix is rare and many from one in which it isn't. How far a row ascends is
decided where its vector is hashed, on a small forest of a bounded sample: the sum of
what shares its prefix there, scaled to all rows. Every array holds every row.
Vectors travel to the trees as int8; the pairs that survive are compared again with
the full vectors.

A row whose surroundings are denser than that (see ``_ascend``) is open: it is
compared with every vector that can be near enough, in blocks.

Equal vectors are one leaf: a class with its size and its smallest identifiers.
So the copies of a vector, however many, cost one row per tree, and every one of
them still gets its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sorted_arrays as A
from ..operators.heaps import best_k
from ..operators.skew import HOT_KEYS
from ..session import Scratch, rows_of

#: The int8 cosine of two vectors is within this of the true one.
INT8_ERROR = 0.02
#: A row is open if more rows of its window than this can't be told from its k best ones by int8.
TIES = 64
#: ... or if half of what it looks at is within this of its k-th best or the least similarity wanted.
CROWD = 0.15
#: Places of a sorted array whose rows look at candidates together.
SPAN = 1024
#: Bits up to which the small forest counts by table, not by search.
TABLE_BITS = 16


def _class_keys(v: pa.Array) -> np.ndarray:
    """128 bits of each vector, rounded to 1e-5, as two longs: equal directions are equal keys."""
    r = np.rint(A.matrix(v, "<f4", A.DIMS).astype(np.float64) * 1e5).astype(np.int64).astype(np.uint64)
    rng = np.random.default_rng(128)
    with np.errstate(over="ignore"):
        a = rng.integers(1, 2**63, (A.DIMS, 2)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        sums = np.stack([(r * a[:, i]).sum(axis=1, dtype=np.uint64) for i in (0, 1)], axis=1)
    return A.mixed(sums).view(np.int64)


def _keyed(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                k = _class_keys(x.column("v"))
                yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(k[:, 0]), pa.array(k[:, 1]), x.column("v")], names=["id", "k1", "k2", "v"])

    return vectors.mapInArrow(run, "id bigint, k1 bigint, k2 bigint, v binary")


def classes(vectors: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (``id``, ``k1``, ``k2``, each once) and classes of equal vectors.

    A class has ``rep`` (its smallest id), ``k1``, ``k2``, ``n`` members, ``ids`` (the k + 1 smallest) and ``v``. The
    vectors are shuffled once, by class, and written once.
    """
    keyed = _keyed(vectors)
    members = scratch.table(keyed.select("id", "k1", "k2").distinct(), "members")
    facts = members.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), best_k(F.col("id"), k + 1, True).alias("ids"))
    facts = facts.select("k1", "k2", "n", F.array_sort("ids").alias("ids")).withColumn("rep", F.col("ids")[0])
    return members, scratch.table(facts.join(keyed.groupBy("k1", "k2").agg(F.first("v").alias("v")), ["k1", "k2"]), "classes")


class SmallForest:
    """The sorted arrays of a sample, in which a row finds how far to ascend."""

    def __init__(self, sample: np.ndarray, h: np.ndarray, rows: int):
        self.keys = [np.sort(A.bit_strings(sample, t)) for t in h]
        self.scale = rows / max(1, len(sample))
        bins = [np.bincount(k >> (A.BITS - TABLE_BITS), minlength=1 << TABLE_BITS) for k in self.keys]
        self.table = np.array([np.concatenate([[0], np.cumsum(b)]) for b in bins], dtype=np.int32)

    def _shared(self, keys: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
        """Rows of the sample that share the first ``bits`` bits with each key, added over the trees."""
        n = np.zeros(len(bits), np.int64)
        low = np.int64(A.BITS) - bits
        if not len(bits) or bits.max() <= TABLE_BITS:
            w = TABLE_BITS - bits
            for t, k in enumerate(keys):
                p = k >> low
                n += self.table[t][(p + 1) << w] - self.table[t][p << w]
            return n
        for own, k in zip(self.keys, keys):
            p = k >> low
            n += np.searchsorted(own, (p << low) + ((np.int64(1) << low) - 1), "right") - np.searchsorted(own, p << low, "left")
        return n

    def levels(self, keys: list[np.ndarray], wanted: float) -> np.ndarray:
        """The longest prefix that, shared in all trees at once, gives each row about ``wanted`` candidates."""
        need = max(1.0, wanted / self.scale)
        n = len(keys[0])
        lo, hi = np.zeros(n, np.int64), np.full(n, TABLE_BITS, np.int64)  # the answer is at least lo

        def search(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            own = [k[at] for k in keys]
            while (lo < hi).any():
                mid = (lo + hi + 1) // 2
                ok = self._shared(own, mid) >= need
                lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
            return lo

        out = search(np.arange(n), lo, hi)
        deep = np.flatnonzero(out == TABLE_BITS)
        if len(deep):
            out[deep] = search(deep, out[deep], np.full(len(deep), A.BITS, np.int64))
        return out


def _tree_rows(classes_df: DataFrame, h: np.ndarray, edges: list[np.ndarray], parts: int, small: SmallForest, wanted: float) -> DataFrame:
    """One row per class and tree: ``part``, ``key``, ``rep``, ``q`` (int8 vector), ``level`` (bits to share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            u, ids = A.matrix(x.column("v"), "<f4", A.DIMS), x.column("rep").to_numpy()
            q = A.binary(A.quantized(u))
            keys = [A.bit_strings(u, t) for t in h]
            level = pa.array(small.levels(keys, wanted).astype(np.int8))
            for t, k in enumerate(keys):
                part = (A.range_of(k, edges[t], ids, t) + t * parts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(k), x.column("rep"), q, level], names=["part", "key", "rep", "q", "level"])

    return A.by_range(classes_df.select("rep", "v").mapInArrow(run, "part int, key bigint, rep bigint, q binary, level tinyint"), parts * len(h))


def reach(keys: np.ndarray, at: np.ndarray, level: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the stretch of a sorted array that shares ``level`` bits with each of the rows ``at``, at most ``most`` to either side."""
    low = np.int64(A.BITS) - level.astype(np.int64)
    p = keys[at] >> low << low
    lo, hi = np.searchsorted(keys, p, "left"), np.searchsorted(keys, p + ((np.int64(1) << low) - 1), "right")
    return np.maximum(lo, at - most), np.minimum(hi, at + most + 1)


def together(at: np.ndarray, level: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (positions in ``at``) of one level whose places in the array are near each other."""
    group = level.astype(np.int64) * (1 << 40) + at // SPAN
    order = np.argsort(group, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(group[order])) + 1)


def _ascend(most: int, k: int, min_similarity: float) -> object:
    """Within a sorted range: of the rows that share its prefix with each row, those that may be its ``k`` best ones.

    ``i``, ``j``; with ``i`` = ``j`` an open row and ``b``, which its k-th similarity is not below.
    """
    least = min_similarity - INT8_ERROR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = A.whole(batches)
        if got is None:
            return
        order = np.argsort(got.column("key").to_numpy(), kind="stable")
        keys, ids = got.column("key").to_numpy()[order], got.column("rep").to_numpy()[order]
        level = got.column("level").to_numpy()[order]
        u = A.unit(A.matrix(got.column("q"), "i1", A.DIMS)[order])
        n, ii, jj, bb = len(ids), [], [], []
        los, his = reach(keys, np.arange(n), level, most)
        for mine in together(np.arange(n), level) if n else ():
            lo, hi = int(los[mine].min()), int(his[mine].max())
            s = u[mine] @ u[lo:hi].T
            s[np.arange(len(mine)), mine - lo] = -2
            m = min(k, hi - lo)
            rows = np.flatnonzero((s >= max(least, min_similarity - CROWD if hi - lo > TIES else least)).any(axis=1))
            if not len(rows):
                continue
            s = s[rows]
            kth = np.maximum(np.partition(s, hi - lo - m, axis=1)[:, hi - lo - m], least)
            good = s >= np.maximum(kth - 2 * INT8_ERROR, least)[:, None]
            crowd = (s >= (np.maximum(kth, min_similarity) - CROWD)[:, None]).sum(axis=1)
            wide = np.flatnonzero((good.sum(axis=1) > TIES) | (crowd > max((hi - lo) // 2, TIES)))
            good[wide] = False
            r, c = np.nonzero(good)
            ii += [ids[mine[rows[r]]], ids[mine[rows[wide]]]]
            jj += [ids[lo + c], ids[mine[rows[wide]]]]
            bb += [np.full(len(r), -2.0), np.maximum(kth[wide] - INT8_ERROR, min_similarity).astype(np.float64)]
        if ii:
            i, j, b = np.concatenate(ii), np.concatenate(jj), np.concatenate(bb)
            for a in range(0, len(i), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (i, j, b)], names=["i", "j", "b"])

    return run


def _leaders(dense: DataFrame, near: float = 0.9, rounds: int = 12) -> np.ndarray:
    """Vectors of which one is ``near`` most dense rows; what is near none is only slower to compare."""
    out = np.zeros((0, A.DIMS), np.float32)
    for turn in range(rounds):

        def far(batches: Iterator[pa.RecordBatch], c: np.ndarray = out) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if x.num_rows:
                    u = A.matrix(x.column("v"), "<f4", A.DIMS)
                    yield pa.RecordBatch.from_arrays([x.column("rep"), x.column("v")], names=["id", "v"]).filter(pa.array(_nearest(u, c)[1] < near))

        left = dense.select("rep", "v").mapInArrow(far, "id bigint, v binary")
        n = left.count()
        if not n:
            break
        for v in A.sample_vectors(left, n, A.SAMPLE_ROWS // 4):
            if not len(out) or (out @ v).max() < near:
                out = np.vstack([out, v[None]])
    return out


def _nearest(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``c`` nearest to each row of ``u``, and its cosine."""
    best, s = np.zeros(len(u), np.int64), np.full(len(u), -2, np.float32)
    for a in range(0, len(c), 4096):
        x = u @ c[a : a + 4096].T
        m = x.argmax(axis=1)
        top = x[np.arange(len(u)), m]
        best, s = np.where(top > s, m + a, best), np.maximum(s, top)
    return best, s


def _compared(cls: DataFrame, dense: DataFrame, k: int, scratch: Scratch, block: int = 40_000) -> DataFrame:
    """``i``, ``j``: the best partners of the dense rows (``rep``, ``v``, ``b``) among all, each compared with every row
    that the triangle inequality doesn't rule out: cell by cell around leaders, block against block."""
    c = _leaders(dense)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                best, s = _nearest(A.matrix(x.column("v"), "<f4", A.DIMS), c)
                b = x.column("b").to_numpy()
                angle = np.arccos(np.clip(s.astype(np.float64), -1, 1)) + np.arccos(np.clip(b, -1, 1)) + 1e-3
                yield pa.RecordBatch.from_arrays([pa.array(best), x.column("rep"), x.column("v"), x.column("b"), pa.array(angle)], names=["cell", "rep", "v", "b", "angle"])

    asks = scratch.table(dense.select("rep", "v", "b").mapInArrow(cells, "cell bigint, rep bigint, v binary, b double, angle double"), "asks")
    facts = asks.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).toArrow()
    reach, nq = np.full(len(c), 2.0, np.float32), np.zeros(len(c), np.int64)
    at = facts.column("cell").to_numpy()
    reach[at], nq[at] = np.cos(np.minimum(facts.column("angle").to_numpy(), np.pi)) - 1e-6, facts.column("n").to_numpy()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            u = A.matrix(x.column("v"), "<f4", A.DIMS)
            for a in range(0, x.num_rows, 1024):
                for d in range(0, len(c), 4096):
                    r, m = np.nonzero(u[a : a + 1024] @ c[d : d + 4096].T >= reach[d : d + 4096])
                    if len(r):
                        take = pa.array(a + r)
                        yield pa.RecordBatch.from_arrays([pa.array(m + d), x.column("rep").take(take), x.column("v").take(take)], names=["cell", "rep", "v"])

    near = scratch.table(cls.select("rep", "v").mapInArrow(held, "cell bigint, rep bigint, v binary"), "held")
    facts = near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    nx = np.zeros(len(c), np.int64)
    nx[facts.column("cell").to_numpy()] = facts.column("n").to_numpy()
    qs, xs = -(-nq // block), -(-nx // block)
    first = np.concatenate([[0], np.cumsum(qs * xs)])
    parts = int(max(1, min(first[-1], max(16, -(-int(nq.sum() + nx.sum()) // block) * int(max(qs.max(), xs.max()))))))

    def spread(asking: bool) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if not x.num_rows:
                    continue
                cell, mix = x.column("cell").to_numpy(), A.mixed(x.column("rep").to_numpy()) >> np.uint64(7)
                mine, others = (qs, xs) if asking else (xs, qs)
                own = (mix % mine[cell].astype(np.uint64)).astype(np.int64)
                for o in range(int(others[cell].max())):
                    take = np.flatnonzero(others[cell] > o)
                    if len(take):
                        t, cl = pa.array(take), cell[take]
                        pair = own[take] * xs[cl] + o if asking else o * xs[cl] + own[take]
                        b = x.column("b").take(t) if asking else pa.nulls(len(take), pa.float64())
                        unit = first[cl] + pair
                        yield pa.RecordBatch.from_arrays([pa.array((unit % parts).astype(np.int32)), pa.array(unit), x.column("rep").take(t), x.column("v").take(t), b], names=["part", "unit", "rep", "v", "b"])

        return run

    fields = "part int, unit bigint, rep bigint, v binary, b double"
    keep = k + 3

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = A.whole(batches)
        if got is None:
            return
        unit, ids, b = got.column("unit").to_numpy(), got.column("rep").to_numpy(), got.column("b").to_numpy(zero_copy_only=False).astype(np.float32)
        v = A.matrix(got.column("v"), "<f4", A.DIMS)
        order = np.lexsort((np.isnan(b), unit))
        for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            asking = rows[~np.isnan(b[rows])]
            other = rows[np.isnan(b[rows])]
            other = other[np.argsort(ids[other])]
            if not len(other):
                continue
            few = v[other[::16]].T
            x = v[other].T
            for a in range(0, len(asking), 256):
                q = asking[a : a + 256]
                bound = b[q] - np.float32(1e-5)
                if few.shape[1] > keep:  # the k-th of a part is not above the k-th of all; the row itself may be among them
                    s = v[q] @ few
                    bound = np.maximum(bound, np.partition(s, few.shape[1] - keep, axis=1)[:, few.shape[1] - keep] - np.float32(1e-6))
                s = v[q] @ x
                at = np.minimum(np.searchsorted(ids[other], ids[q]), len(other) - 1)
                own = np.flatnonzero(ids[other[at]] == ids[q])
                s[own, at[own]] = -2
                r, m = np.nonzero(s >= bound[:, None])
                w = s[r, m]
                o = np.lexsort((-w, r))
                r, m, w = r[o], m[o], w[o]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                r, m, w = r[rank < keep], m[rank < keep], w[rank < keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[r]]), pa.array(ids[other[m]]), pa.array(w.astype(np.float64))], names=["i", "j", "s"])

    both = asks.mapInArrow(spread(True), fields).unionAll(near.mapInArrow(spread(False), fields))
    got = A.by_range(both, parts).select("unit", "rep", "v", "b").mapInArrow(compare, "i bigint, j bigint, s double")
    got = got.groupBy("i").agg(best_k(F.struct("s", (-F.col("j")).alias("j")), keep, False).alias("x"))
    return got.select("i", F.explode("x").alias("x")).select("i", (-F.col("x.j")).alias("j"))


def _cosines(pairs: DataFrame) -> DataFrame:
    """Adds ``s``, the cosine of the unit vectors ``v`` and ``w``, which it drops."""

    @F.pandas_udf("double")
    def cosine(a, b):  # noqa: ANN001
        import pandas as pd

        x, y = (np.frombuffer(b"".join(c), "<f4").reshape(-1, A.DIMS).astype(np.float64) for c in (a, b))
        return pd.Series((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)))

    return pairs.withColumn("s", cosine("v", "w")).drop("v", "w")


def neighbours(frames: DataFrame, k: int = 5, min_similarity: float = -1.0, trees: int = 10, window: int = 384, rows_per_part: int = 60_000, seed: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``id``, ``rank``, ``neighbour``, ``similarity``: the ``k`` most similar other vectors of every vector.

    Vectors of another length, with non-finite numbers or all zero, and null keys, don't take part and get no
    rows; a row delivered twice counts once; norms don't matter. Ties go to the smaller identifier. Copies have
    similarity 1 to each other. ``min_similarity`` leaves out less similar neighbours early. Fewer than ``k`` rows
    come out for a vector only if fewer were found. The hyperplanes are random; range borders and the length of the
    prefixes come from a sample of ``SAMPLE_ROWS`` vectors; every vector is in every tree. A row ascends until it has
    about 2 * ``window`` candidates a tree, in whatever trees they are (at most 4 * ``window`` to either side of its place
    in one). Trees and window trade time for accuracy (see README); in a place too dense for that every row is compared
    with all that can be near enough, whatever that takes.
    """
    spark = frames.sparkSession
    scratch = scratch or Scratch(spark, "forest")
    vectors = A.valid_vectors(frames)
    members, facts = classes(vectors, k, scratch)
    rows = rows_of(facts)
    parts = max(1, -(-rows // rows_per_part))
    h = A.planes(trees, A.BITS, A.DIMS, seed)
    sample = A.sample_vectors(facts.select(F.col("rep").alias("id"), "v"), rows, A.SAMPLE_ROWS)
    edges = [A.borders(A.bit_strings(sample, t), parts) for t in h]
    found = _tree_rows(facts, h, edges, parts, SmallForest(sample, h, rows), 2.0 * window * trees).select("key", "rep", "q", "level")
    near = found.mapInArrow(_ascend(4 * window, k, min_similarity), "i bigint, j bigint, b double")
    # A pair may come from both its ends and from several trees; its cosine is wanted once.
    near = scratch.table(near.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("b").alias("b")), "near")
    wide = near.where("i = j").select(F.col("i").alias("rep"), "b")
    close = near.where("i <> j").select("i", "j")
    if not wide.isEmpty():
        dense = scratch.table(facts.join(wide, "rep").select("rep", "v", "b"), "dense")
        more = _compared(facts, dense, k, scratch)
        close = scratch.table(close.unionAll(more.select(F.least("i", "j"), F.greatest("i", "j"))).distinct(), "near")
        scratch.drop(dense)
    ends = close.select(F.col("i").alias("rep")).unionAll(close.select("j")).distinct()
    # Only vectors of classes with a candidate go on.
    full = scratch.table(facts.join(ends, "rep", "left_semi").select("rep", "v"), "ends")
    exact = close.join(full.withColumnRenamed("rep", "ri"), F.col("i") == F.col("ri")).select("i", "j", "v")
    exact = exact.join(full.select(F.col("rep").alias("rj"), F.col("v").alias("w")), F.col("j") == F.col("rj")).select("i", "j", "v", "w")
    pairs = scratch.table(_cosines(exact).where(F.col("s") >= min_similarity), "pairs")
    scratch.drop(near, close, full)
    return _expand(pairs, members, facts, scratch, k)


def _expand(pairs: DataFrame, members: DataFrame, facts: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """From pairs of classes to neighbours of members. Classes without a partner and with one member have none."""
    sides = pairs.select(F.col("i").alias("c"), F.col("j").alias("d"), "s").unionAll(pairs.select("j", "i", "s"))
    best = sides.groupBy("c").agg(best_k(F.struct("s", (-F.col("d")).alias("d")), k, False).alias("near"))
    best = best.select("c", F.explode("near").alias("x")).select("c", (-F.col("x.d")).alias("d"), F.col("x.s").alias("s"))
    others = best.join(facts.select(F.col("rep").alias("d"), "ids"), "d").select("c", F.explode("ids").alias("o"), "s")
    own = facts.where("n > 1").select(F.col("rep").alias("c"), F.explode("ids").alias("o"), F.lit(1.0).alias("s"))
    lists = others.unionAll(own).groupBy("c").agg(best_k(F.struct("s", (-F.col("o")).alias("o")), k + 1, False).alias("near"))
    lists = facts.select("k1", "k2", "rep", "n").join(lists, F.col("rep") == F.col("c")).select("k1", "k2", "n", "near")
    lists = scratch.table(lists, "lists")
    total = rows_of(members)
    hot = F.col("n") * HOT_KEYS > total  # at most HOT_KEYS classes
    big = members.join(F.broadcast(lists.where(hot)), ["k1", "k2"])
    rest = members.join(lists.where(~hot), ["k1", "k2"])
    all_rows = big.unionByName(rest)
    mine = F.slice(F.filter("near", lambda x: -x["o"] != F.col("id")), 1, k)
    out = all_rows.select("id", F.posexplode(mine).alias("rank", "x"))
    return out.select("id", (F.col("rank") + 1).alias("rank"), (-F.col("x.o")).alias("neighbour"), F.col("x.s").alias("similarity"))


def search(frames: DataFrame, queries: DataFrame, k: int = 5, trees: int = 24, share: float = 0.12, rows_per_part: int = 120_000, seed: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``id``, ``rank``, ``neighbour``, ``similarity`` for the frames whose ``frame_id`` is in ``queries``.

    As ``neighbours``, for a stated set of queries. A query ascends until the trees together offer it ``share`` of the
    collection (at least 4,096 rows), repeats between trees included, so ranks among many nearly equal neighbours come
    out too. ``queries`` has ``frame_id``; null ones and those without a usable vector get no rows.
    """
    spark = frames.sparkSession
    scratch = scratch or Scratch(spark, "search")
    wanted = queries.select(F.col("frame_id").cast("long").alias("qid")).where("qid is not null").distinct()
    vectors = scratch.table(A.valid_vectors(frames).dropDuplicates(["id"]), "vectors")
    base = vectors.join(wanted, vectors["id"] == wanted["qid"], "left").select("id", "v", F.col("qid").isNotNull().alias("asks"))
    rows = rows_of(vectors)
    budget = max(4096.0, share * rows)
    most = int(8 * budget / trees)
    parts = max(1, rows // max(rows_per_part, 2 * most))
    h = A.planes(trees, A.BITS, A.DIMS, seed)
    sample = A.sample_vectors(vectors, rows, A.SAMPLE_ROWS)
    edges = [A.borders(A.bit_strings(sample, t), parts) for t in h]
    small = SmallForest(sample, h, rows)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            u, ids = A.matrix(x.column("v"), "<f4", A.DIMS), x.column("id").to_numpy()
            q = A.binary(A.quantized(u))
            keys = [A.bit_strings(u, t) for t in h]
            asks = np.flatnonzero(np.asarray(x.column("asks").to_pylist(), dtype=bool))
            level = np.full(len(u), -1, np.int8)
            level[asks] = small.levels([key[asks] for key in keys], budget)
            for t, key in enumerate(keys):
                part = (A.range_of(key, edges[t], ids) + t * parts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key), x.column("id"), q, pa.array(level)], names=["part", "key", "id", "q", "level"])

    keep = 4 * k

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = A.whole(batches)
        if got is None:
            return
        order = np.argsort(got.column("key").to_numpy(), kind="stable")
        keys, ids = got.column("key").to_numpy()[order], got.column("id").to_numpy()[order]
        level = got.column("level").to_numpy()[order]
        asks = np.flatnonzero(level >= 0)
        u = A.unit(A.matrix(got.column("q"), "i1", A.DIMS)[order])
        los, his = reach(keys, asks, level[asks], most)
        for group in together(asks, level[asks]) if len(asks) else ():
            for a in range(0, len(group), 32):
                g = group[a : a + 32]
                mine, lo, hi = asks[g], int(los[g].min()), int(his[g].max())
                s = u[mine] @ u[lo:hi].T
                s[np.arange(len(mine)), mine - lo] = -2
                m = min(keep, hi - lo - 1)
                if m < 1:
                    continue
                top = np.argpartition(s, hi - lo - m, axis=1)[:, hi - lo - m :]
                r = np.repeat(np.arange(len(mine)), m)
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine[r]]), pa.array(ids[lo + top.ravel()]), pa.array(s[r, top.ravel()].astype(np.float64))], names=["i", "j", "s"])

    rows_df = A.by_range(base.mapInArrow(spread, "part int, key bigint, id bigint, q binary, level tinyint"), parts * trees)
    near = rows_df.select("key", "id", "q", "level").mapInArrow(look, "i bigint, j bigint, s double")
    # The int8 order decides which candidates are compared exactly: four times as many as are wanted.
    near = near.groupBy("i", "j").agg(F.max("s").alias("s")).groupBy("i").agg(best_k(F.struct("s", (-F.col("j")).alias("j")), keep, False).alias("x"))
    near = near.select("i", F.explode("x").alias("x")).select("i", (-F.col("x.j")).alias("j"))
    exact = near.join(vectors.select(F.col("id").alias("j"), F.col("v").alias("w")), "j")
    exact = exact.join(base.where("asks").select(F.col("id").alias("i"), "v"), "i")
    heaps = _cosines(exact.select("i", "j", "v", "w")).groupBy("i").agg(best_k(F.struct("s", (-F.col("j")).alias("j")), k, False).alias("x"))
    out = heaps.select("i", F.posexplode("x").alias("rank", "x"))
    return out.select(F.col("i").alias("id"), (F.col("rank") + 1).alias("rank"), (-F.col("x.j")).alias("neighbour"), F.col("x.s").alias("similarity"))
