"""Filling containers of fixed capacity with whole items.

Minimum bin slack over a histogram: the number of different lengths is bounded
by the capacity, so the remaining multiset of lengths is a table of at most
``capacity`` counts, whatever the number of items. The plan is made on that
table: the longest remaining length opens a window, a bitset subset-sum program
over the remaining lengths finds the fill closest to the capacity, the counts
are read back from the bitsets, and the fill is repeated while the counts last.
The items find their containers by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Scratch


def fill(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """Counts of lengths whose sum is as close to ``room`` as the multiset allows, from below.

    Bit s of ``reach`` is set if sum s can be made; after each step (so many copies of one length) the bitset is
    kept, which is all that is needed to read the counts back. The search ends when the room can be filled.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            new = reach | (reach << (length * take)) & full
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    s = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> s & 1:
            out[length] = out.get(length, 0) + take
            s -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Runs of containers with the same fill: first container, number of containers, counts by length."""
    counts = {k: v for k, v in histogram.items() if 0 < k <= capacity and v > 0}
    order = sorted(counts, reverse=True)
    out, at = [], 0
    while order:
        top = order[0]
        counts[top] -= 1
        inside = fill(capacity - top, order, counts)
        counts[top] += 1
        inside[top] = inside.get(top, 0) + 1
        times = min(counts[k] // n for k, n in inside.items())
        out.append((at, times, inside))
        at += times
        gone = False
        for k, n in inside.items():
            counts[k] -= n * times
            gone |= counts[k] == 0
        if gone:
            order = [k for k in order if counts[k]]
    return out


def pack(sized: DataFrame, capacity: int, key: str = "doc_id", size: str = "size", salt: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """Where every item goes: ``container``, ``key``, ``part``, ``start``, ``tokens``, ``fill`` of the container.

    Items of at most ``capacity`` are never split. A larger item is cut into full parts and a rest (``start`` and
    ``tokens`` are ranges of its tokens). Items of size 0 or null take no space and are spread over all containers
    (container 0 if there is no other). A repeated key counts once, with its largest size; rows with a null key
    are left out; no items give no rows; other columns don't matter. Equal lengths are ranked by a hash of the key
    in ``salt`` ranges, so that a length of any share of the rows is spread.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = sized.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    d = sized.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.greatest(F.coalesce(F.max(size), F.lit(0)).cast("long"), F.lit(0)).alias("n"))
    starts = F.when(F.col("n") > capacity, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    d = d.select("k", "n", F.posexplode(starts).alias("part", "start"))
    d = d.select("k", "part", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("long").alias("tokens"))
    d = scratch.table(d.withColumn("range", F.pmod(F.xxhash64("k", "part"), F.lit(salt)).cast("int")), "items")
    ranges = d.groupBy("tokens", "range").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("tokens", "range", (F.sum("n").over(W.partitionBy("tokens").orderBy("range")) - F.col("n")).alias("base"), "n")
    ranges = scratch.table(ranges, "ranges")  # at most (capacity + 1) * salt rows
    histogram = {int(r[0]): int(r[1]) for r in ranges.groupBy("tokens").agg(F.sum("n")).collect()}
    runs = plan(histogram, capacity)
    total = max(1, sum(t for _, t, _ in runs))

    used = dict.fromkeys(histogram, 0)
    rows = []
    for at, times, inside in runs:
        whole = sum(k * n for k, n in inside.items())
        for k, n in inside.items():
            rows.append((k, used[k], n, at, whole))
            used[k] += n * times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    # Bounded by the capacity: a run ends when a length can't fill it again, and it has few lengths.
    shared = spark.sparkContext.broadcast((table, total))

    # Both sides lie by length and range, as the ranks need them; nothing that grows is broadcast.
    ranked = d.join(ranges.select("tokens", "range", "base").hint("merge"), ["tokens", "range"])
    ranked = ranked.withColumn("rank", F.col("base") + F.row_number().over(W.partitionBy("tokens", "range").orderBy(F.xxhash64("k"), "k", "part")) - 1)
    kind = d.schema["k"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, n = shared.value
        firsts = np.searchsorted(t[:, 0], np.arange(capacity + 2))
        for x in batches:
            tok, rank = x["tokens"].to_numpy(np.int64), x["rank"].to_numpy(np.int64)
            container, whole = rank % n, np.zeros(len(x), np.int64)
            order = np.argsort(tok, kind="stable")
            edges = np.flatnonzero(np.diff(tok[order], prepend=-1))
            for a, z in zip(edges, [*edges[1:], len(order)]):
                rows = order[a:z]
                length = int(tok[rows[0]])
                if length:
                    own = t[firsts[length] : firsts[length + 1]]
                    hit = own[np.searchsorted(own[:, 1], rank[rows], "right") - 1]
                    container[rows] = hit[:, 3] + (rank[rows] - hit[:, 1]) // hit[:, 2]
                    whole[rows] = hit[:, 4]
            yield pd.DataFrame({"container": container, key: x["k"], "part": x["part"], "start": x["start"], "tokens": tok, "fill": whole})

    placed = ranked.select("k", "part", "start", "tokens", "rank").mapInPandas(place, f"container bigint, {key} {kind}, part int, start bigint, tokens bigint, fill bigint")
    if not histogram.get(0):
        return placed
    empty = F.col("tokens") == 0
    fills = placed.where(~empty).groupBy("container").agg(F.max("fill").alias("f"))
    zero = placed.where(empty).join(fills.hint("merge"), "container", "left").withColumn("fill", F.coalesce("f", F.lit(0).cast("long")))
    return placed.where(~empty).unionByName(zero.select(*placed.columns))
