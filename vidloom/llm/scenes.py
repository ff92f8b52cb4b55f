"""Clusters of mutually similar vectors, each with its size and most typical members.

A vector is the set of the signs of 256 random projections. A band puts vectors that
point most along the same random directions into the same bucket, whose rows are in
MinHash order where it is too large to be compared whole; in a bucket the exact Jaccard
similarity decides which vectors match. Unrelated vectors agree in a MinHash value of such
sets one time in three, in a strongest direction one time in 128, so buckets of directions
stay small with few bands. Matches are kept as stars: in a block of
a bucket the vector of highest degree (the medoid) takes its matches, then the
next one among those that are left, so a bucket of m rows gives fewer than m
links. What the blocks of a bucket leave over is compared block against block.
Stars that share a vector are connected components. A component whose vectors
don't point the same way is loose; it is split back into its stars around the
medoids of highest degree.

The components give mean directions; those of the same scene are merged. A set can make
vectors match that aren't alike enough, so that small groups are taken for one scene whose
mean lies between them; a scene therefore needs its number of rows in one piece, in which
the mean cosine of the vectors themselves is enough. The vectors that are near no scene go
through banding with other hashes, until two thorough rounds in a row find no further scene.
A vector then belongs to the scene of its component, if it is close enough to the mean
direction of that scene and no other mean is closer; only means that can be closer are
looked at. What has no component, or doesn't agree with it, is compared with all means.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sorted_arrays as A
from ..operators.heaps import best_k
from ..session import Scratch, rows_of
from .components import contract

PROJECTIONS = 256
#: Values of a band signature: 9 bits each fill a long.
VALUES = 7
#: Rows up to which a band has 4 values; one more for each further factor of 3, to which unrelated buckets shrink.
BAND_ROWS = 400_000
#: Unrelated rows of a bucket of directions, were they spread evenly, up to which it isn't divided further; measured: up to twice as many.
BUCKET_ROWS = 300
STARS = "id bigint, medoid bigint, degree bigint, total binary"
#: A row of a thorough band: its bucket, its id and its set.
SET_ROW = np.dtype([("key", "<i4"), ("id", "<i8"), ("set", f"V{PROJECTIONS // 8}")])
#: Mean directions that are compared with vectors at once; more are taken in several passes.
MEANS_PER_PASS = 8192


def _projections(seed: int) -> np.ndarray:
    return np.concatenate(A.planes(PROJECTIONS // A.DIMS, A.DIMS, A.DIMS, seed), axis=1)


def signs(u: np.ndarray, seed: int) -> np.ndarray:
    """The set of a vector: token 2i + 1 if projection i is positive, else token 2i."""
    return u @ _projections(seed) > 0


def band_keys(s: np.ndarray, seed: int) -> np.ndarray:
    """``VALUES`` MinHash values of each set, packed into a long, first value highest.

    A MinHash value is the token of the set that comes first in a random order of all tokens. One token of each
    projection is in the set, so going through the order decides half of the rows per step.
    """
    out = np.zeros(len(s), np.int64)
    for v in range(VALUES):
        order = np.random.default_rng((seed, v)).permutation(2 * PROJECTIONS)
        value, open_ = np.zeros(len(s), np.int64), np.arange(len(s))
        for token in order:
            hit = s[open_, token >> 1] == bool(token & 1)
            value[open_[hit]] = token
            open_ = open_[~hit]
            if not len(open_):
                break
        out = (out << 9) | value
    return out


def stars(agree: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """Medoids with their matches (themselves included): highest degree first, each row in one star."""
    open_ = np.flatnonzero(agree.sum(axis=1) >= least)
    out = []
    m = agree[np.ix_(open_, open_)]
    while len(open_):
        degree = m.sum(axis=1)
        k = int(np.argmax(degree))
        if degree[k] < least:
            break
        took = m[k]
        out.append((int(open_[k]), open_[took]))
        open_, m = open_[~took], m[np.ix_(~took, ~took)]
    return out


def _bands(rows: int) -> tuple[int, int]:
    """For bands of MinHash values alone, which the rounds don't use because they need so many (see ``_directions``):
    number of bands and of values per band: wider ones for many rows, so that buckets don't grow with them, and as
    many more as make up for the chance that two rows of a small scene have a member of it in their bucket (2.3 per value)."""
    wider = 0
    while rows > BAND_ROWS * 3**wider and wider < VALUES - 4:
        wider += 1
    return round(8 * 2.3**wider), 4 + wider


def _directions(rows: int) -> tuple[int, int]:
    """Number of bands and of axes of the second direction of a bucket: more axes for more rows, so that buckets don't
    grow with them, and more bands as a small scene has fewer members in one bucket (1.23 times for twice the axes)."""
    k = 0
    while rows > BUCKET_ROWS * 8 * A.DIMS * 2**k and k < 5:
        k += 1
    return round(9 * 1.23**k), 2 << k


def buckets_of(u: np.ndarray, axes: int, seed: int) -> np.ndarray:
    """The strongest of the 128 directions of a random basis and of the ``2 * axes`` of another one, as one number."""
    out = np.zeros(len(u), np.int64)
    for basis, n in zip(A.planes(2, A.DIMS, A.DIMS, seed), (A.DIMS, axes), strict=True):
        p = u @ basis[:, :n]
        k = np.abs(p).argmax(axis=1)
        out = (out << 7) | 2 * k + (p[np.arange(len(u)), k] > 0)
    return out


def _part_of(buckets: np.ndarray, parts: int, band: int) -> np.ndarray:
    return ((A.mixed(buckets) >> np.uint64(17)) % np.uint64(parts)).astype(np.int32) + np.int32(band * parts)


def _banded(left: DataFrame, bands: list[int], axes: int, parts: int, seed: int) -> DataFrame:
    """``key``, ``id``, ``q`` of the vectors that are left, once per band; a bucket is in one partition.

    The key is the bucket, then five MinHash values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            u, ids = A.matrix(x.column("v"), "<f4", A.DIMS), x.column("id")
            s, q = signs(u, seed), A.binary(A.quantized(u))
            for t, b in enumerate(bands):
                bucket = buckets_of(u, axes, b)
                keys = (bucket << 45) | (band_keys(s, b) >> 18)
                yield pa.RecordBatch.from_arrays([pa.array(_part_of(bucket, parts, t)), pa.array(keys), ids, q], names=["part", "key", "id", "q"])

    return A.by_range(left.mapInArrow(run, "part int, key bigint, id bigint, q binary"), parts * len(bands))


def _sets(left: DataFrame, bands: list[int], axes: int, parts: int, seed: int, rows: int = 65_536) -> DataFrame:
    """The sets of the vectors that are left, once per band: as ``SET_ROW``s, those for one partition of a task together."""

    def packed(x: pa.Table) -> Iterator[pa.RecordBatch]:
        u = A.matrix(x.column("v"), "<f4", A.DIMS)
        out = np.empty(len(u), SET_ROW)
        out["id"] = x.column("id").to_numpy()
        out["set"] = np.packbits(signs(u, seed), axis=1).view(SET_ROW["set"])[:, 0]
        for t, b in enumerate(bands):
            bucket = buckets_of(u, axes, b)
            part = _part_of(bucket, parts, t)
            out["key"] = bucket
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.diff(part[order], prepend=-1))
            ends = (np.append(first, len(u)) * SET_ROW.itemsize).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(out[order].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(part[order][first]), blobs], names=["part", "sets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in batches:
            if x.num_rows:
                held.append(x)
            if sum(h.num_rows for h in held) >= rows:
                yield from packed(A.whole(iter(held)))
                held = []
        if held:
            yield from packed(A.whole(iter(held)))

    return A.by_range(left.mapInArrow(run, "part int, sets binary"), parts * len(bands))


def _far(left: DataFrame, means: np.ndarray, near: float) -> DataFrame:
    """The vectors that are ``near`` none of the means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield x.filter(pa.array(_best(A.matrix(x.column("v"), "<f4", A.DIMS), means)[1] < near))

    return left.mapInArrow(run, "id bigint, v binary")


def _matches(rows: int, jaccard: float, least: int, seed: int, across: bool = True, block: int = 512) -> object:
    """Stars of the sorted buckets, of larger ones ``across`` their blocks: rows ``(id, medoid)`` and, per medoid, its degree and summed vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = A.whole(batches)
        if got is None:
            return
        keys = got.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        q = A.matrix(got.column("q"), "i1", A.DIMS)

        def vectors(rows: np.ndarray) -> np.ndarray:
            return A.unit(q[order[rows]])

        def values(rows: np.ndarray) -> np.ndarray:
            return np.where(signs(vectors(rows), seed), np.float32(1), np.float32(-1))

        yield from _stars_of(keys[order] >> (9 * (VALUES - rows)), got.column("id").to_numpy()[order], values, vectors, jaccard, least, across, block)

    return run


def _set_matches(jaccard: float, least: int, seed: int, block: int = 512) -> object:
    """As ``_matches``, for ``_sets``. A vector is put together from its set, which gives it with some noise."""
    # A projection of a unit vector is as long as this in the mean.
    back = _projections(seed).T / np.float32(PROJECTIONS * np.sqrt(2 / (np.pi * A.DIMS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(v.as_buffer(), SET_ROW) for x in batches for v in x.column("sets")]
        if not got:
            return
        got = np.concatenate(got)
        got = got[np.argsort(got["key"], kind="stable")]
        sets = np.ascontiguousarray(got["set"]).view(np.uint8).reshape(len(got), -1)

        def values(rows: np.ndarray) -> np.ndarray:
            return np.unpackbits(sets[rows], axis=1).astype(np.float32) * 2 - 1

        yield from _stars_of(got["key"], np.ascontiguousarray(got["id"]), values, lambda rows: values(rows) @ back, jaccard, least, True, block)

    return run


def _stars_of(buckets: np.ndarray, ids: np.ndarray, values: object, vectors: object, jaccard: float, least: int, across: bool, block: int) -> Iterator[pa.RecordBatch]:
    """``values`` and ``vectors`` give the signs (1 or -1) and the vectors of rows, which are in order of their buckets."""
    # |A and B| / |A or B| for sets with one token per projection: agreement p gives p / (2 - p).
    agreement = 2 * jaccard / (1 + jaccard) * PROJECTIONS
    who, star, deg, sums, heads = [], [], [], [], []
    ends = np.append(np.flatnonzero(np.diff(buckets)) + 1, len(ids))
    free, at = np.ones(len(ids), bool), {}

    def add(medoid: int, took: np.ndarray) -> None:
        free[took] = False
        total = vectors(took).sum(axis=0)
        if ids[medoid] in at:
            k = at[ids[medoid]]
            who[k], star[k] = np.append(who[k], ids[took]), np.append(star[k], np.full(len(took), ids[medoid]))
            deg[k], sums[k] = deg[k] + len(took), sums[k] + total
            return
        at[ids[medoid]] = len(heads)
        who.append(ids[took])
        star.append(np.full(len(took), ids[medoid]))
        heads.append(ids[medoid])
        deg.append(len(took))
        sums.append(total)

    a = 0
    while a < len(ids):
        begin, end = np.searchsorted(buckets, buckets[a]), ends[np.searchsorted(ends, a, "right")]
        large = end - begin > block
        # As many whole buckets as a block takes; a larger bucket goes block by block.
        z = min(end, a + block) if large else ends[np.searchsorted(ends, a + block, "right") - 1]
        s = values(np.arange(a, z))
        agree = (s @ s.T + PROJECTIONS) / 2 >= agreement
        agree &= buckets[a:z, None] == buckets[None, a:z]
        for medoid, took in stars(agree, least):
            add(a + medoid, a + took)
        if across and large and z == end:
            medoids = begin + np.flatnonzero([i in at for i in ids[begin:end]])
            _across(begin + np.flatnonzero(free[begin:end]), medoids, values, add, agreement, least, 4 * block)
        a = z
    if heads:
        n, m = sum(map(len, who)), len(heads)
        none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(star)), *none], names=["id", "medoid", "degree", "total"])
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(np.array(heads)), pa.array(np.array(deg, dtype=np.int64)), A.binary(np.array(sums, dtype="<f4"))], names=["id", "medoid", "degree", "total"])


def _across(rest: np.ndarray, medoids: np.ndarray, values: object, add: object, agreement: float, least: int, block: int) -> None:
    """What the blocks of a bucket left over: rows that match a medoid join its star, the others make new stars."""
    rows = np.sort(np.concatenate([rest, medoids]))
    ii, jj = [], []
    for a in range(0, len(rows), block):
        s = values(rows[a : a + block])
        for b in range(a, len(rows), block):
            i, j = np.nonzero((s @ (s if a == b else values(rows[b : b + block])).T + PROJECTIONS) / 2 >= agreement)
            ii += [i + a, j + b] if a != b else [i + a]
            jj += [j + b, i + a] if a != b else [j + b]
    if not ii:
        return
    i, j = np.concatenate(ii), np.concatenate(jj)
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(len(rows) + 1))
    taken = np.isin(rows, medoids, assume_unique=True)
    for m in np.flatnonzero(taken):
        near = j[first[m] : first[m + 1]]
        near = near[~taken[near]]
        if len(near):
            taken[near] = True
            add(rows[m], rows[near])
    degree = np.bincount(i[~taken[i] & ~taken[j]], minlength=len(rows))
    heap = [(-d, k) for k, d in enumerate(degree.tolist()) if d >= least]
    heapq.heapify(heap)
    while heap:
        d, k = heapq.heappop(heap)
        if taken[k]:
            continue
        near = j[first[k] : first[k + 1]]
        near = near[~taken[near]]
        if len(near) < -d:
            if len(near) >= least:
                heapq.heappush(heap, (-len(near), k))
            continue
        taken[near] = True
        add(rows[k], rows[near])


def _add_vectors(rows: DataFrame, key: str) -> DataFrame:
    """Per ``key`` the sums of ``degree`` and of the vectors ``total``, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keys, inv = np.unique(x.column("k").to_numpy(), return_inverse=True)
                t = np.zeros((len(keys), A.DIMS))
                np.add.at(t, inv, A.matrix(x.column("total"), "<f4", A.DIMS))
                n = np.bincount(inv, x.column("degree").to_numpy(), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), *[pa.array(c) for c in t.T]], names=["k", "degree", *[f"c{i}" for i in range(A.DIMS)]])

    cols = ", ".join(f"c{i} double" for i in range(A.DIMS))
    part = rows.select(F.col(key).alias("k"), "degree", "total").mapInArrow(run, f"k bigint, degree bigint, {cols}")
    return part.groupBy("k").agg(F.sum("degree").alias("degree"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(A.DIMS)])


def _vectors_of(sums: DataFrame, extra: str) -> tuple[np.ndarray, np.ndarray]:
    t = sums.select(extra, F.array(*[f"c{i}" for i in range(A.DIMS)]).alias("c")).toArrow()
    v = np.asarray(t.column("c").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, A.DIMS)
    return t.column(extra).to_numpy(), v


def merge_means(sizes: np.ndarray, sums: np.ndarray, alike: float, block: int = 512) -> np.ndarray:
    """Summed vectors as mean directions: the largest first, each takes those at least ``alike``."""
    sums = sums[np.argsort(-sizes, kind="stable")]
    u = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-30)
    heads, total = np.zeros((len(u), A.DIMS)), np.zeros((len(u), A.DIMS))
    n = 0
    for a in range(0, len(u), block):
        x = u[a : a + block]
        owner = np.full(len(x), -1)
        if n:
            hit = x @ heads[:n].T >= alike
            owner = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        for k in np.flatnonzero(owner < 0):
            if owner[k] < 0:
                took = (owner < 0) & (x @ x[k] >= alike)
                took[k] = True
                owner[took] = n
                heads[n] = x[k]
                n += 1
        np.add.at(total, owner, sums[a : a + block])
    out = total[:n]
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-30)).astype(np.float32)


def _nuclei(stars_df: DataFrame, least_rows: int, tight: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Summed vectors of the components of stars (``k``); loose components fall apart into their stars.

    Also ``id``, ``k``: the component, or the star, of every vector that has one.
    """
    links = stars_df.where("id is not null").select("id", "medoid")
    spans = links.groupBy("id").agg(F.min("medoid").alias("a"), F.max("medoid").alias("b"), F.array_distinct(F.collect_list("medoid")).alias("all"))  # one per band
    spans = scratch.table(spans, "spans")
    chains = spans.where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    labels = contract(chains, scratch, seed=4211)
    heads = stars_df.where("id is null").select("medoid", "degree", "total")
    heads = heads.join(labels, heads["medoid"] == labels["v"], "left").select("medoid", F.coalesce("root", "medoid").alias("root"), "degree", "total")
    # A few near copies meet in every band, so their degrees add up; their number of rows doesn't.
    held = spans.join(labels, spans["a"] == labels["v"], "left").groupBy(F.coalesce("root", "a").alias("root")).count().where(F.col("count") >= 4 * least_rows // 5)
    heads = scratch.table(heads.join(held, "root", "left_semi"), "stars")
    norm = F.sqrt(sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(A.DIMS)), F.lit(0.0)))
    comps = scratch.table(_add_vectors(heads, "root").withColumn("bundle", norm / F.col("degree")), "components")
    loose = comps.where(F.col("bundle") < tight).select(F.col("k").alias("root"))
    single = heads.join(loose, "root", "left_semi")
    stars_sum = _add_vectors(single.where(F.col("degree") >= least_rows), "medoid")
    nuclei = comps.where((F.col("bundle") >= tight) & (F.col("degree") >= least_rows)).drop("bundle").unionByName(stars_sum)
    names = heads.join(loose.withColumn("apart", F.lit(True)), "root", "left").select("medoid", F.when(F.col("apart"), F.col("medoid")).otherwise(F.col("root")).alias("k")).distinct()
    members = spans.select("id", F.col("a").alias("medoid")).join(names, "medoid").select("id", "k")
    out = scratch.table(nuclei, "nuclei"), scratch.table(members, "members")
    scratch.drop(spans, heads, comps, labels)
    return out


def _condense(nuclei: DataFrame, alike: float, scratch: Scratch, group: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Nuclei merged to mean directions with their weights.

    Nuclei that point the same way are merged in groups of about ``group``, sorted by a hash string so that like
    ones meet, with other hyperplanes each time, until the remaining ones fit one group. If passes stop helping,
    the directions really are that many; they are taken as they are.
    """
    n, passes, stale = rows_of(nuclei), 0, 0
    while n > group and stale < 3:
        h = A.planes(1, 48, A.DIMS, 900 + passes)[0]

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if x.num_rows:
                    v = np.stack([x.column(f"c{i}").to_numpy() for i in range(A.DIMS)], axis=1)
                    yield x.append_column("h", pa.array(A.bit_strings(v.astype(np.float32), h)))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = A.whole(batches)
            if t is None:
                return
            v = np.stack([t.column(f"c{i}").to_numpy() for i in range(A.DIMS)], axis=1)
            order, size = np.argsort(t.column("h").to_numpy(), kind="stable"), t.column("degree").to_numpy()
            for a in range(0, len(v), group):
                o = order[a : a + group]
                m = merge_means(size[o], v[o], alike)
                w = np.argmax((v[o] @ m.T), axis=1)
                d = np.bincount(w, size[o], len(m)).astype(np.int64)
                s = np.zeros((len(m), A.DIMS))
                np.add.at(s, w, v[o])
                yield pa.RecordBatch.from_arrays([pa.array(t.column("k").to_numpy()[o[: len(m)]]), pa.array(d), *[pa.array(c) for c in s.T]], names=["k", "degree", *[f"c{i}" for i in range(A.DIMS)]])

        cols = "k bigint, degree bigint, " + ", ".join(f"c{i} double" for i in range(A.DIMS))
        sortable = nuclei.select("k", "degree", *[f"c{i}" for i in range(A.DIMS)]).mapInArrow(key, cols + ", h bigint")
        nuclei = scratch.table(sortable.repartitionByRange(max(1, n // group), "h").mapInArrow(join, cols), "merged")
        n, before = rows_of(nuclei), n
        stale = stale + 1 if n > 0.98 * before else 0
        passes += 1
    return _vectors_of(nuclei, "degree")


def _scene_of(nuclei: DataFrame, means: np.ndarray, least: float) -> DataFrame:
    """``k``, ``scene``: the mean that each nucleus points to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                v = np.stack([x.column(f"c{i}").to_numpy() for i in range(A.DIMS)], axis=1)
                u = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-30)
                best, s = _best(u.astype(np.float32), means)
                ok = np.flatnonzero(s >= least)
                yield pa.RecordBatch.from_arrays([x.column("k").take(pa.array(ok)), pa.array(best[ok])], names=["k", "scene"])

    return nuclei.select("k", *[f"c{i}" for i in range(A.DIMS)]).mapInArrow(run, "k bigint, scene bigint")


def _confirm(rows: DataFrame, means: np.ndarray, least: float) -> DataFrame:
    """``id``, ``scene`` (row of ``means``), ``s`` of every vector with cosine at least ``least`` to its best mean.

    ``rows``: ``id``, ``v``, ``scene`` (that of its component, or null). A vector that is close enough to the mean of its
    own scene can only be closer to means within twice that angle of it, so only those are compared; the vectors
    without a scene, or too far from it, are compared with all means.
    """
    wide = np.cos(min(np.pi, 2 * np.arccos(least))) - 1e-5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, np.ndarray] = {}
        for x in batches:
            if not x.num_rows:
                continue
            u = A.matrix(x.column("v"), "<f4", A.DIMS)
            own = x.column("scene").fill_null(-1).to_numpy()
            best, s = own.copy(), np.full(len(u), -2, np.float32)
            has = np.flatnonzero(own >= 0)
            s[has] = (u[has] * means[own[has]]).sum(axis=1)
            ok = has[s[has] >= least]
            for g in np.split(ok[np.argsort(own[ok], kind="stable")], np.flatnonzero(np.diff(np.sort(own[ok]))) + 1):
                if not len(g):
                    continue
                c = int(own[g[0]])
                if c not in near:
                    if len(near) > 4096:
                        near.clear()
                    near[c] = np.flatnonzero(means @ means[c] >= wide)
                t = u[g] @ means[near[c]].T
                k = t.argmax(axis=1)
                best[g], s[g] = near[c][k], t[np.arange(len(g)), k]
            rest = np.setdiff1d(np.arange(len(u)), ok, assume_unique=True)
            if len(rest):
                best[rest], s[rest] = _best(u[rest], means)
            ok = np.flatnonzero(s >= least)
            yield pa.RecordBatch.from_arrays([x.column("id").take(pa.array(ok)), pa.array(best[ok]), pa.array(s[ok].astype(np.float64))], names=["id", "scene", "s"])

    return rows.select("id", "v", "scene").mapInArrow(run, "id bigint, scene bigint, s double")


def _best(u: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, s = np.zeros(len(u), np.int64), np.full(len(u), -2, np.float32)
    for a in range(0, len(means), MEANS_PER_PASS):
        c = u @ means[a : a + MEANS_PER_PASS].T
        k = c.argmax(axis=1)
        top = c[np.arange(len(u)), k]
        more = top > s
        best[more], s[more] = k[more] + a, top[more]
    return best, s


def _means(base: DataFrame, means: np.ndarray, least: float, since: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Number and summed vector of the vectors assigned to each mean from ``since`` on, in order of the means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t = np.zeros(len(means), np.int64), np.zeros((len(means), A.DIMS))
        for x in batches:
            if x.num_rows:
                u = A.matrix(x.column("v"), "<f4", A.DIMS)
                best, s = _best(u, means)
                ok = s >= least
                n += np.bincount(best[ok], minlength=len(means))
                order = np.argsort(best[ok], kind="stable")
                b = best[ok][order]
                if len(b):
                    first = np.flatnonzero(np.diff(b, prepend=-1))
                    t[b[first]] += np.add.reduceat(u[ok][order].astype(np.float64), first, axis=0)
        k = since + np.flatnonzero(n[since:])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k]), *[pa.array(c) for c in t[k].T]], names=["k", "degree", *[f"c{i}" for i in range(A.DIMS)]])

    cols = ", ".join(f"c{i} double" for i in range(A.DIMS))
    part = base.mapInArrow(run, f"k bigint, degree bigint, {cols}")
    got = part.groupBy("k").agg(F.sum("degree").alias("degree"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(A.DIMS)]).toArrow()
    n, t, k = np.zeros(len(means), np.int64), np.zeros((len(means), A.DIMS)), got.column("k").to_numpy()
    n[k] = got.column("degree").to_numpy()
    for i in range(A.DIMS):
        t[k, i] = got.column(f"c{i}").to_numpy()
    return n[since:], t[since:]


def in_one_piece(u: np.ndarray, cosine: float, least_rows: int) -> bool:
    """Whether ``least_rows`` of the vectors hang together: in some order each has this mean cosine to those before it."""
    while len(u) >= least_rows:
        took, total = np.zeros(len(u), bool), np.zeros(len(u), np.float32)
        k = int((u @ u.sum(axis=0)).argmax())
        for n in range(1, len(u) + 1):
            if n == least_rows:
                return True
            took[k] = True
            total += u @ u[k]
            k = int(np.where(took, -np.inf, total).argmax())
            if took[k] or total[k] < cosine * n:
                break
        u = u[~took]
    return False


def _pieces(base: DataFrame, means: np.ndarray, some: np.ndarray, parts: int, least: float, cosine: float, least_rows: int) -> np.ndarray:
    """Those of ``some`` means (rows of ``means``) of whose vectors ``least_rows`` are ``in_one_piece``."""
    part_of = np.full(len(means), -1, np.int32)
    part_of[some] = np.arange(len(some)) * parts // len(some)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            u = A.matrix(x.column("v"), "<f4", A.DIMS)
            near = np.flatnonzero(_best(u, means[some])[1] >= least - 1e-5)
            best, s = _best(u[near], means)
            ok = np.flatnonzero((s >= least) & (part_of[best] >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(part_of[best[ok]]), pa.array(best[ok]), x.column("v").take(pa.array(near[ok]))], names=["part", "k", "v"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = A.whole(batches)
        if t is None:
            return
        k, u = t.column("k").to_numpy(), A.matrix(t.column("v"), "<f4", A.DIMS)
        order = np.argsort(k, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(k[order])) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([int(k[g[0]]) for g in groups if in_one_piece(u[g], cosine, least_rows)], pa.int64())], names=["k"])

    picked = A.by_range(base.mapInArrow(pick, "part int, k bigint, v binary"), parts)
    return picked.select("k", "v").mapInArrow(judge, "k bigint").toArrow().column("k").to_numpy()


def scenes(frames: DataFrame, similarity: float = 0.77, apart: float = 0.6, least_rows: int = 20, jaccard: float = 0.53, rows_per_part: int = 60_000, seed: int = 17, scratch: Scratch | None = None) -> DataFrame:
    """``id``, ``cluster`` (its smallest id), ``similarity`` to the mean direction, ``size`` of the cluster.

    A cluster has at least ``least_rows`` vectors, each with cosine at least ``similarity`` to the mean direction of
    its cluster and less to any other; means of at least ``apart`` are one cluster. Smaller groups that aren't alike
    (``in_one_piece``) make no cluster together, though the mean between them may be close enough to all. All other
    vectors, and those that are not 64 finite numbers or all zero, are left out. Only directions count; a row delivered
    twice counts once; ties between clusters go to the larger one; no rows give no rows.
    """
    spark: SparkSession = frames.sparkSession
    scratch = scratch or Scratch(spark, "scenes")
    base = scratch.table(A.valid_vectors(frames).groupBy("id").agg(F.first("v").alias("v")), "vectors")
    rows = left = rows_of(base)
    known = np.zeros((0, A.DIMS), np.float32)
    near = (similarity + apart) / 2
    # Vectors spread around a mean at this similarity have its square as their mean cosine; less the chance deviation of a pair.
    tie = similarity**2 - (1 - similarity**2) / A.DIMS**0.5
    todo, turn, idle = base, 0, 0
    grouped: list[tuple[DataFrame, DataFrame]] = []
    while left:
        # The first round only takes out the frequent scenes. The later ones see fewer rows, and find the small scenes.
        count, axes = _directions(left)
        bands = [seed * 1000 + turn * 100 + b for b in range(count if turn else 2)]
        parts = max(1, -(-left // rows_per_part))
        if turn == 0:
            found = _banded(todo, bands, axes, parts, seed).select("key", "id", "q").mapInArrow(_matches(2, jaccard, 3, seed, False), STARS)
        else:
            found = _sets(todo, bands, axes, parts, seed + turn).select("sets").mapInArrow(_set_matches(jaccard, 3, seed + turn), STARS)
        found = scratch.table(found, "stars")
        nuclei, members = _nuclei(found, least_rows // 2, 0.72, scratch)
        scratch.drop(found)
        sizes, sums = _condense(nuclei, (1 + apart) / 2, scratch)
        fresh = merge_means(sizes, sums, apart) if len(sizes) else known[:0]
        if len(known) and len(fresh):
            fresh = fresh[_best(fresh, known)[1] < apart]
        for least in (near, similarity):  # by what is left alone; the others are nearer to a scene that is known
            if len(fresh):
                n, t = _means(todo, fresh, least)
                fresh = merge_means(n[n >= least_rows // 2], t[n >= least_rows // 2], apart)
        if len(fresh):  # a scene needs its number of rows among all vectors, however near other scenes some of them are
            every = np.concatenate([known, fresh])
            n, t = _means(base, every, similarity, len(known))
            ok = n >= least_rows
            # In pieces of fewer rows the mean cosine of all pairs is at most this, so only few and small scenes are looked at.
            doubt = np.flatnonzero(ok & ((t * t).sum(axis=1) <= n * (n * tie + (least_rows - 1) * (1 - tie)) + 1e-3 * n))
            if len(doubt):
                ok[doubt] = np.isin(len(known) + doubt, _pieces(base, every, len(known) + doubt, max(1, -(-int(n[doubt].sum()) // rows_per_part)), similarity, tie, least_rows))
            fresh = merge_means(n[ok], t[ok], apart)
        if len(known) and len(fresh):
            fresh = fresh[_best(fresh, known)[1] < apart]
        if len(fresh):
            known = np.concatenate([known, fresh])
            grouped.append((nuclei, members))
            before, todo = todo, scratch.table(_far(todo, fresh, near), "left")
            left = rows_of(todo)
            if before is not base:
                scratch.drop(before)
        else:
            scratch.drop(nuclei, members)
        # Only rounds that look for small scenes end the search: two in a row, with other hashes, that find none.
        idle = 0 if len(fresh) or turn == 0 else idle + 1
        if idle == 2:
            break
        turn += 1
    for least in (near, similarity, similarity):
        if len(known):
            n, t = _means(base, known, least)
            few = least_rows // 2 if least == near else least_rows
            known = merge_means(n[n >= few], t[n >= few], apart)
    if not len(known):
        return spark.createDataFrame([], "id bigint, cluster bigint, similarity double, size bigint")
    labels = [m.join(_scene_of(g, known, apart), "k").select("id", F.struct(F.lit(i).alias("turn"), "scene").alias("x")) for i, (g, m) in enumerate(grouped)]
    labelled = labels[0]
    for x in labels[1:]:
        labelled = labelled.unionAll(x)
    labelled = labelled.groupBy("id").agg(F.max("x").alias("x")).select(F.col("id").alias("lid"), F.col("x.scene").alias("scene"))
    placed = scratch.table(_confirm(base.join(labelled, base["id"] == F.col("lid"), "left"), known, similarity), "placed")
    scratch.drop(base, todo, *[x for pair in grouped for x in pair])
    facts = placed.groupBy("scene").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least_rows)
    # One row per scene, of which there are at most rows / least_rows; Spark broadcasts it only below its threshold.
    return placed.join(facts, "scene").select("id", "cluster", F.col("s").alias("similarity"), "size")


def describe(clusters: DataFrame, typical: int = 5) -> DataFrame:
    """Per cluster its ``size`` and ``typical`` most typical members (``rank``, ``id``, ``similarity``)."""
    heap = best_k(F.struct("similarity", (-F.col("id")).alias("i")), typical, False)
    top = clusters.groupBy("cluster").agg(F.max("size").alias("size"), heap.alias("x"))
    top = top.select("cluster", "size", F.posexplode("x").alias("rank", "x"))
    return top.select("cluster", "size", (F.col("rank") + 1).alias("rank"), (-F.col("x.i")).alias("id"), F.col("x.similarity").alias("similarity"))
