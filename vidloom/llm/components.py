"""Groups of records that are linked directly or indirectly.

Random contraction of the link graph: in each round every vertex hooks to the
member of its closed neighbourhood that comes first in a fresh hash order, both
ends of every edge are relabelled to what their vertex hooked to, loops and
repeated edges go. Half of the vertices of a path, and more of anything denser,
disappear per round, so the number of rounds is logarithmic in the number of
vertices, however long the chains are. The mappings of the rounds are then
composed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import Scratch, rows_of


def contract(edges: DataFrame, scratch: Scratch, seed: int = 20240) -> DataFrame:
    """Vertex to root for long vertex ids.

    ``edges`` has the long columns ``a`` and ``b``. Nulls and loops are ignored. Returns ``v``, ``root``; every
    vertex of an edge is there once. Each round writes two tables to the scratch folder, so that lost executors
    cost no more than the tasks they ran.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    # The salt of the hash order is a column, so that all rounds run the same compiled code.
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(seed).cast("long").alias("salt")).distinct()
    e = scratch.table(e, "edges")
    steps: list[DataFrame] = []
    n = rows_of(e)
    while n:
        both = e.select("a", "b", "salt").unionAll(e.select(F.col("b"), F.col("a"), F.col("salt")))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min_by("b", F.xxhash64("b", "salt")).alias("w"), F.count(F.lit(1)).alias("degree"), F.max("salt").alias("salt"))
        hook = F.when(F.xxhash64("v", "salt") <= F.xxhash64("w", "salt"), F.col("v")).otherwise(F.col("w"))
        hooks = scratch.table(near.select("v", hook.alias("r"), "degree"), "hooks")
        steps.append(hooks)
        moved = lookup(e, "a", hooks, "v", "r", "degree", 2 * n, "x")
        moved = lookup(moved, "b", hooks, "v", "r", "degree", 2 * n, "y")
        nxt = moved.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("salt") + 7919).alias("salt")).distinct()
        nxt = scratch.table(nxt, "edges")
        scratch.drop(e)
        e, n = nxt, rows_of(nxt)
    scratch.drop(e)
    if not steps:
        return edges.sparkSession.createDataFrame([], "v bigint, root bigint")
    labels = steps[-1].select("v", F.col("r").alias("root"))
    for k, hooks in enumerate(reversed(steps[:-1])):
        h = hooks.select(F.col("v").alias("u"), F.col("r"))
        labels = h.join(labels, h["r"] == labels["v"], "left").select(F.col("u").alias("v"), F.coalesce("root", "r").alias("root"))
        if k % 4 == 3:
            labels = scratch.table(labels, f"labels{k}")
    labels = scratch.table(labels, "labels")
    scratch.drop(*steps)
    return labels


def linked_groups(pairs: DataFrame, left: str, right: str, member: str = "member", group: str = "group", scratch: Scratch | None = None) -> DataFrame:
    """One row per record that is linked to another one, with the smallest key of its group.

    ``pairs[left]`` and ``pairs[right]`` are keys of any one orderable type; all other columns are ignored, so
    their names may clash. A pair with a null key, or of a record with itself, links nothing; repeated pairs
    count once; no pairs give no rows. Strings are compared by code point.
    """
    scratch = scratch or Scratch(pairs.sparkSession, "groups")
    p = pairs.select(F.col(left).alias("l"), F.col(right).alias("r"))
    p = p.where(F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") != F.col("r")))
    p = scratch.table(p.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r")).distinct(), "pairs")
    n = rows_of(p)
    keys = p.select(F.col("l").alias("key")).unionAll(p.select(F.col("r").alias("key")))
    keys = keys.groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    # Ids are made once and written, so that a task that runs again cannot make others.
    ids = scratch.table(keys.select("key", F.monotonically_increasing_id().alias("v"), "degree"), "ids")
    edges = lookup(p, "l", ids, "key", "v", "degree", 2 * n, "a")
    edges = lookup(edges, "r", ids, "key", "v", "degree", 2 * n, "b")
    labels = contract(edges, scratch)
    named = scratch.table(ids.join(labels, "v").select(F.col("key"), F.col("root")), "named")
    firsts = scratch.table(named.groupBy("root").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("size")), "firsts")
    out = lookup(named, "root", firsts, "root", "first", "size", rows_of(named), group)
    return out.select(F.col("key").alias(member), F.col(group))


