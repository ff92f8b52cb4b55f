"""The N best rows of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.heaps import best_k


def top_n(df: DataFrame, group: list[str], score: str, tie: list[str], n: int, limit: str | None = None, heap: str = "heap") -> DataFrame:
    """One row per group with its ``n`` best rows, best first, in the array column ``heap``.

    A heap of at most ``n`` entries per group is filled on the map side, merged after the shuffle, and never
    grows, so a group of millions of rows costs each map task n entries. Order: ``score`` from high to low, then
    the ``tie`` columns (numbers, ending in a unique identifier) from low to high, a null tie last. Rows with a
    null or NaN score or a null identifier are left out. Null group keys form a group of their own, as in SQL.
    The entries are structs ``(score, tie...)``. Repeated rows fill places: pass rows once. No rows give none.
    """
    score_c: Column = F.col(score).cast("double")
    rows = df.where(score_c.isNotNull() & ~F.isnan(score_c) & F.col(tie[-1]).isNotNull())
    entry = F.struct(score_c.alias("s"), *[(-F.col(t)).alias(f"t{i}") for i, t in enumerate(tie)])
    heaps = rows.groupBy(*group).agg(best_k(entry, n, False).alias("__h"))
    back = F.transform("__h", lambda x: F.struct(x["s"].alias(score), *[(-x[f"t{i}"]).alias(t) for i, t in enumerate(tie)]))
    return heaps.select(*group, back.alias(heap))


def candidate_matches(matches: DataFrame, pairs: DataFrame, configs: DataFrame) -> DataFrame:
    """``match_id`` (with rank and score) of the best ``candidate_limit`` matches of every source frame.

    A match that was delivered more than once counts once; similarities above 1 are percentages; they are
    compared after rounding to 4 decimals. Matches without a source frame, with a null or NaN similarity, or of
    a pair without a configuration don't count.
    """
    sim = F.col("similarity")
    m = matches.where(F.col("source_frame_index").isNotNull() & sim.isNotNull() & ~F.isnan(sim) & F.col("match_id").isNotNull())
    m = m.withColumn("ratio", F.round(F.when(sim > 1, sim / 100).otherwise(sim), 4))
    keys = ["match_id", "pair_id", "direction", "source_frame_index", "ratio"]
    m = m.groupBy(*keys).agg(F.max("target_frame_index").alias("target_frame_index"))
    # analysis_config is a settings table; its largest limit bounds every heap.
    n = configs.agg(F.max("candidate_limit")).first()[0] or 0
    heaps = top_n(m, ["pair_id", "direction", "source_frame_index"], "ratio", ["target_frame_index", "match_id"], max(1, n))
    limits = configs.groupBy("config_id").agg(F.max("candidate_limit").alias("keep"))
    limits = pairs.groupBy("pair_id").agg(F.max("config_id").alias("config_id")).join(limits, "config_id").select("pair_id", "keep")
    kept = heaps.join(limits, "pair_id").where(F.col("keep") > 0)
    kept = kept.select("pair_id", "direction", "source_frame_index", F.posexplode(F.slice("heap", 1, F.col("keep"))).alias("rank", "m"))
    return kept.select("pair_id", "direction", "source_frame_index", (F.col("rank") + 1).alias("rank"), "m.match_id", "m.target_frame_index", F.col("m.ratio").alias("similarity"))
