"""Greedy clusters of time offsets, coverage and segments.

Matches of a pair and direction are ordered by offset (target time minus source
time). A match joins the current cluster if its offset is within a tolerance of
the cluster's running mean, else it opens the next one. Equal offsets always join
together, so the fold runs over distinct offsets with counts, and a group of any
number of matches is as small as its number of different offsets. The fold is a
stream over sorted partitions; it keeps one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .skew import null_safe_join

#: Fixed value: tolerance in seconds of the coverage estimate.
COVERAGE_TOLERANCE = 3.0


def offset_clusters(matches: DataFrame, keys: list[str], tolerance: float, digits: int = 6) -> DataFrame:
    """``matches`` with ``offset`` (rounded to ``digits``) and ``cluster`` (0, 1, ... in order of offset).

    ``matches`` has ``src_ts`` and ``tgt_ts`` in seconds; rows with a null or NaN time are left out. Offsets further
    apart than the tolerance can't share a cluster, so the fold starts afresh there and a group is split into
    independent runs.
    """
    m = matches.where("src_ts is not null and tgt_ts is not null and not isnan(src_ts) and not isnan(tgt_ts)")
    m = m.withColumn("offset", F.round(F.col("tgt_ts") - F.col("src_ts"), digits) + F.lit(0.0))
    distinct = m.groupBy(*keys, "offset").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(*keys).orderBy("offset")
    runs = distinct.withColumn("new", F.when(F.col("offset") - F.lag("offset").over(by) <= tolerance, 0).otherwise(1)).withColumn("run", F.sum("new").over(by)).drop("new")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total, count, part = None, 0.0, 0, 0
        for x in batches:
            ids = list(zip(*[x[c] for c in [*keys, "run"]]))
            parts = np.empty(len(x), np.int64)
            for i, (key, o, n) in enumerate(zip(ids, x["offset"].to_numpy(), x["n"].to_numpy())):
                if key != last:
                    last, total, count, part = key, o * n, n, 0
                elif abs(o - total / count) <= tolerance:
                    total, count = total + o * n, count + n
                else:
                    total, count, part = o * n, n, part + 1
                parts[i] = part
            yield x.assign(part=parts)[[*keys, "offset", "run", "part"]]

    fields = ", ".join(f"`{c}` {distinct.schema[c].dataType.simpleString()}" for c in [*keys, "offset"])
    folded = runs.repartition(*keys, "run").sortWithinPartitions(*keys, "run", "offset").mapInPandas(fold, f"{fields}, run bigint, part bigint")
    numbered = folded.withColumn("cluster", F.dense_rank().over(W.partitionBy(*keys).orderBy("run", "part")) - 1).drop("run", "part")
    return null_safe_join(m, numbered, [*keys, "offset"]).select(*m.columns, "cluster")


def _clusters(clustered: DataFrame, keys: list[str]) -> DataFrame:
    return clustered.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("frames"), F.min("src_ts").alias("source_start"), F.max("src_ts").alias("source_end"),
        F.min("tgt_ts").alias("target_start"), F.max("tgt_ts").alias("target_end"), F.avg("sim").alias("avg_similarity"), F.stddev_pop("offset").alias("offset_std"),
    )


def temporal_coverage(matches: DataFrame, keys: list[str], totals: str, tolerance: float = COVERAGE_TOLERANCE) -> DataFrame:
    """Per group the share of source frames in its best time-consistent cluster.

    ``matches``: ``keys``, ``src``, ``src_ts``, ``tgt_ts``, ``sim`` and ``totals``, the number of source frames of the
    group. A cluster counts if it has at least min(3, matches, total) matches and, unless the source has at most 3
    frames, spans at least a second on one side. Its score is distinct frames times mean similarity; the best one
    (the lowest offset among equals) gives the coverage. Groups without a valid cluster, with a null total or one
    that isn't positive get 0; groups without matches have no row.
    """
    c = _clusters(offset_clusters(matches, keys, tolerance), keys)
    facts = matches.where("src_ts is not null and tgt_ts is not null and not isnan(src_ts) and not isnan(tgt_ts)").groupBy(*keys).agg(F.max(totals).alias("total"), F.count(F.lit(1)).alias("all"))
    x = null_safe_join(facts, c.drop("offset_std"), keys)
    long_enough = (F.col("total") <= 3) | (F.greatest(F.col("source_end") - F.col("source_start"), F.col("target_end") - F.col("target_start")) >= 1.0)
    valid = (F.col("n") >= F.least(F.lit(3).cast("long"), F.col("all"), F.col("total").cast("long"))) & long_enough
    score = F.round(F.col("frames") * F.greatest(F.lit(0.0), F.col("avg_similarity")), 9)
    best = x.groupBy(*keys).agg(F.max("total").alias("total"), F.max(F.when(valid & (score > 0), F.struct(score.alias("s"), (-F.col("cluster")).alias("c"), F.col("frames")))).alias("__best"))
    share = F.least(F.lit(1.0), F.col("__best.frames") / F.col("total"))
    return best.select(*keys, F.when((F.col("total") > 0) & F.col("__best").isNotNull(), share).otherwise(0.0).alias("coverage"))


def segments(matches: DataFrame, keys: list[str], min_duration: float = 5.0, min_matches: int = 3, tolerance: float = 3.0, dedupe: bool = True) -> DataFrame:
    """Time-consistent clusters of enough matches and source duration, with coverage and confidence.

    With ``dedupe`` a segment and its mirror image (source and target ranges swapped) within the same group count
    once: the more confident one, the first in order of offset among equals.
    """
    c = _clusters(offset_clusters(matches, keys, tolerance), keys)
    duration = F.col("source_end") - F.col("source_start")
    s = c.where((F.col("n") >= min_matches) & (duration >= min_duration)).withColumn("duration", duration)
    s = s.withColumn("coverage", F.when(duration > 0, F.least(F.lit(1.0), F.col("n") / F.greatest(F.lit(1.0), duration))).otherwise(1.0))
    steady = F.greatest(F.lit(0.0), 1 - F.when(F.col("n") > 1, F.col("offset_std")).otherwise(0.0) / 10)
    s = s.withColumn("confidence", 0.4 * F.least(F.lit(1.0), F.col("n") / 10) + 0.4 * F.col("avg_similarity") + 0.2 * steady)
    if dedupe:
        one, two = F.struct(F.col("source_start").alias("s"), F.col("source_end").alias("e")), F.struct(F.col("target_start").alias("s"), F.col("target_end").alias("e"))
        w = W.partitionBy(*keys, F.least(one, two), F.greatest(one, two)).orderBy(F.round("confidence", 9).desc(), "cluster")
        s = s.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return s.select(*keys, "source_start", "source_end", "target_start", "target_end", "duration", "coverage", "avg_similarity", "confidence", F.col("n").alias("match_count"))


def fixed_windows(matches: DataFrame, keys: list[str], size: float = 30.0, duration: str | None = None) -> DataFrame:
    """Gap-free windows from the first match of each group on, empty ones included.

    Windows of ``size`` seconds cover the time from the first match to the last one, or to ``duration`` if that is
    later; a group whose matches share one time has one window. A match at the very end of a range that is a
    whole number of windows falls into none. Per window: count, ratio to one frame a second, mean similarity and
    the range of target times; zeros if empty.
    """
    m = matches.where("src_ts is not null and not isnan(src_ts)")
    ends = [F.max("src_ts")] + ([F.max(duration)] if duration else [])
    base = m.groupBy(*keys).agg(F.min("src_ts").alias("first"), (F.greatest(*ends) if duration else ends[0]).alias("last"))
    base = base.withColumn("last", F.when(F.col("last") <= F.col("first"), F.col("first") + size).otherwise(F.col("last")))
    n = F.ceil((F.col("last") - F.col("first")) / size).cast("long")
    spine = base.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    placed = null_safe_join(m.select(*keys, "src_ts", "tgt_ts", "sim"), base, keys).withColumn("k", F.floor((F.col("src_ts") - F.col("first")) / size))
    stats = placed.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n"), F.avg("sim").alias("s"), F.min("tgt_ts").alias("lo"), F.max("tgt_ts").alias("hi"))
    out = null_safe_join(spine, stats, [*keys, "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    count = F.coalesce("n", F.lit(0))
    start = F.col("first") + F.col("k") * size
    return out.select(
        *keys, F.col("k").alias("window"), start.alias("source_start"), (start + size).alias("source_end"), count.alias("matched_frame_count"),
        F.least(F.lit(1.0), count / max(1, int(size))).alias("matched_frame_ratio"), zero("s").alias("avg_similarity"), zero("lo").alias("best_target_start"), zero("hi").alias("best_target_end"),
    )
