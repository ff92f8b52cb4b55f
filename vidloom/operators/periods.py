"""Continuous periods and gaps of overlapping intervals, per entity.

Two levels. Intervals are clipped into time shards of fixed width. Within a
shard they are merged locally; what covers whole shards is not copied into each
of them but counted by a begin and an end mark. Coverage that touches a shard
border is stitched to that of the next shard; everything else is final where it
was made. As only the longest interval of each start counts, a shard of w time
units has at most w rows, however many intervals an entity has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Scratch
from .skew import null_safe_join


def whole_ms(seconds: Column | str) -> Column:
    """Seconds as whole milliseconds; null for null, NaN and what doesn't fit a long."""
    c = (F.col(seconds) if isinstance(seconds, str) else seconds).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 9e15), F.round(c * 1000).cast("long"))


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merged ``s``, ``e`` of the intervals of each combination of ``keys``; touching ones are joined."""
    by = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    numbered = df.withColumn("__new", new).withColumn("__isle", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__isle").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__isle")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, shard: int = 600_000) -> DataFrame:
    """``keys``, ``kind`` (``period`` or ``gap``), ``start``, ``end`` per entity.

    ``start`` and ``end`` are integer columns (milliseconds, say). Intervals with a null bound or not ending after
    their start don't count; touching intervals form one period; a gap is the stretch between two consecutive
    periods. Repeated rows change nothing; null keys form an entity of their own, as in GROUP BY; other columns
    don't matter; no rows give no rows. ``shard`` is the width of a time shard and bounds the rows of a task.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    d = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where(F.col("e") > F.col("s"))
    scratch = Scratch(df.sparkSession, "periods")
    d = d.groupBy(*k, "s").agg(F.max("e").alias("e"))

    # First and last shard of an interval; an end on a border belongs to the shard before it.
    w = F.lit(shard).cast("long")
    d = d.withColumn("a", F.floor(F.col("s") / w).cast("long")).withColumn("z", F.floor((F.col("e") - 1) / w).cast("long"))
    one = F.struct(F.col("a").alias("shard"), F.col("s"), F.least("e", (F.col("a") + 1) * w).alias("e"))
    two = F.struct(F.col("z").alias("shard"), (F.col("z") * w).alias("s"), F.col("e"))
    clips = d.select(*k, F.explode(F.when(F.col("a") == F.col("z"), F.array(one)).otherwise(F.array(one, two))).alias("c")).select(*k, "c.*")
    local = scratch.table(_islands(clips, [*k, "shard"]), "local")  # read by several of the steps below

    marks = d.where(F.col("z") - F.col("a") > 1).select(*k, F.explode(F.array(F.struct((F.col("a") + 1).alias("at"), F.lit(1).alias("n")), F.struct(F.col("z").alias("at"), F.lit(-1).alias("n")))).alias("m"))
    marks = marks.groupBy(*k, F.col("m.at").alias("at")).agg(F.sum("m.n").alias("n"))
    by = W.partitionBy(*k).orderBy("at")
    covered = marks.withColumn("depth", F.sum("n").over(by)).withColumn("next", F.lead("at").over(by)).where(F.col("depth") > 0)
    covered = covered.select(*k, (F.col("at") * w).alias("s"), (F.col("next") * w).alias("e"))

    # What lies inside a shard that a longer interval covers whole is part of that interval's period.
    touched = local.select(*k, F.col("shard").alias("at")).distinct().withColumn("n", F.lit(None).cast("long"))
    upto = W.partitionBy(*k).orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    depth = marks.unionByName(touched).withColumn("depth", F.sum("n").over(upto))
    hidden = depth.where(F.col("n").isNull() & (F.col("depth") > 0)).select(*k, F.col("at").alias("shard"))
    local = null_safe_join(local, hidden, [*k, "shard"], "left_anti")

    at_border = (F.col("s") == F.col("shard") * w) | (F.col("e") == (F.col("shard") + 1) * w)
    stitched = _islands(local.where(at_border).select(*k, "s", "e").unionByName(covered), k)
    periods = scratch.table(local.where(~at_border).select(*k, "s", "e").unionByName(stitched), "periods")

    # Gaps: the period before, within the shard of the start, else the last one of an earlier shard.
    own = periods.withColumn("shard", F.floor(F.col("s") / w).cast("long"))
    inside = W.partitionBy(*k, "shard").orderBy("s")
    own = own.withColumn("before", F.max("e").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    ends = own.groupBy(*k, "shard").agg(F.max("e").alias("last"))
    ends = ends.withColumn("earlier", F.max("last").over(W.partitionBy(*k).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)))
    firsts = own.where(F.col("before").isNull())
    firsts = null_safe_join(firsts.select(*k, "shard", "s"), ends.select(*k, "shard", F.col("earlier").alias("before")), [*k, "shard"]).drop("shard")
    gaps = own.where(F.col("before").isNotNull()).select(*k, "s", "before").unionByName(firsts.where(F.col("before").isNotNull()))
    gaps = gaps.where(F.col("before") < F.col("s")).select(*k, F.lit("gap").alias("kind"), F.col("before").alias("start"), F.col("s").alias("end"))
    out = periods.select(*k, F.lit("period").alias("kind"), F.col("s").alias("start"), F.col("e").alias("end")).unionByName(gaps)
    return out.select(*[F.col(a).alias(c) for a, c in zip(k, keys)], "kind", "start", "end")


def track_periods(segments: DataFrame, windows: DataFrame, shard: int = 600_000) -> DataFrame:
    """``pair_id``, ``track``, ``kind``, ``start_ms``, ``end_ms`` of the segments (A side) and windows of every pair."""
    a = segments.select("pair_id", F.lit("segment").alias("track"), whole_ms("a_start").alias("s"), whole_ms("a_end").alias("e"))
    b = windows.select("pair_id", F.col("direction").alias("track"), whole_ms("source_start").alias("s"), whole_ms("source_end").alias("e"))
    out = periods_and_gaps(a.unionByName(b), ["pair_id", "track"], "s", "e", shard)
    return out.select("pair_id", "track", "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))
