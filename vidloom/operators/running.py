"""Running values along an order, for keys of any size.

Rows are range partitioned by key and order together, so a key with a large share of
all rows lies in several partitions. Values run within a partition; what came before it
is added from the totals of the earlier partitions of the same key. Only keys that cross
a border need that, at most one per border, so that table is bounded by the number of
partitions and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Scratch


def running(
    df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, parts: int | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """``df`` with running columns per ``keys`` in ``order``.

    ``sums``: sum up to and including the row; ``tops``: greatest value up to the row; ``lasts``: last value that isn't
    null, up to the row; ``before``: value of the row before, null at the first one. Null keys form a group. ``order``
    should decide between any two rows of a key; rows that tie come in any order. The rows are written once, so that a
    task that runs again sees the same partitions.
    """
    sums, tops, lasts, before = sums or {}, tops or {}, lasts or {}, before or {}
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "running")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for c in (*sums, *tops, *lasts, *before):
        if c in df.columns:
            raise ValueError(f"column {c} is there already")
    given = df.columns
    values = {**sums, **tops, **lasts, **before}
    t = df.select(*given, *[v.alias(f"__v_{n}") for n, v in values.items()])
    t = t.repartitionByRange(parts, *keys, *order).withColumn("__p", F.spark_partition_id())
    t = scratch.table(t, "ordered")
    w = W.partitionBy("__p", *keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    v = lambda n: F.col(f"__v_{n}")
    local = [F.sum(v(n)).over(upto).alias(f"__l_{n}") for n in sums] + [F.max(v(n)).over(upto).alias(f"__l_{n}") for n in tops]
    local += [F.last(v(n), ignorenulls=True).over(upto).alias(f"__l_{n}") for n in lasts] + [F.lag(v(n)).over(w).alias(f"__l_{n}") for n in before]
    first = [F.row_number().over(w).alias("__rn")] if before else []
    at = F.struct(*order) if lasts or before else F.lit(None)
    ends = [F.sum(v(n)).alias(f"__e_{n}") for n in sums] + [F.max(v(n)).alias(f"__e_{n}") for n in tops]
    ends += [F.max_by(v(n), F.when(v(n).isNotNull(), at)).alias(f"__e_{n}") for n in lasts] + [F.max_by(F.struct(v(n).alias("x")), at).alias(f"__e_{n}") for n in before]
    e = t.groupBy("__p", *keys).agg(*ends).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("__n > 1")
    earlier = W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    carry = [F.sum(f"__e_{n}").over(earlier).alias(f"__c_{n}") for n in sums] + [F.max(f"__e_{n}").over(earlier).alias(f"__c_{n}") for n in tops]
    carry += [F.last(f"__e_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in (*lasts, *before)]
    c = e.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *carry)
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    # At most one key crosses each border of the partitions: fewer than 2 * parts rows.
    j = t.select("*", *local, *first).join(F.broadcast(c), same, "left")
    out = [F.when(F.col(f"__l_{n}").isNotNull() | F.col(f"__c_{n}").isNotNull(), F.coalesce(f"__l_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0))).alias(n) for n in sums]
    out += [F.greatest(f"__l_{n}", f"__c_{n}").alias(n) for n in tops] + [F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in lasts]
    out += [F.when(F.col("__rn") > 1, F.col(f"__l_{n}")).otherwise(F.col(f"__c_{n}")["x"]).alias(n) for n in before]
    return j.select(*given, *out)


def places(df: DataFrame, order: list[str | Column], name: str = "place", scratch: Scratch | None = None) -> DataFrame:
    """``df`` with the place of each row in a total order, from 1; counted in all partitions at once."""
    return running(df, [], order, {name: F.lit(1).cast("long")}, scratch=scratch)
