"""Files with the same content, by size first and by fingerprint second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, rows_of
from .skew import lookup


def duplicate_members(files: DataFrame, key: str, size: str, content: str) -> DataFrame:
    """Members of groups of at least two files with the same size and content.

    Columns: ``group`` (size and fingerprint), ``key``, ``members``, ``first`` (smallest key of the group). Sizes are
    counted first, and only the content of files that share a size is fingerprinted. Empty files, null sizes and
    null keys don't count; a key that comes twice counts once. Counts and minima are combined before the shuffle, so a
    group that holds a large share of all files isn't gathered in one task.
    """
    f = files.select(F.col(key).alias("k"), F.col(size).alias("n"), F.col(content).alias("c")).where("k is not null and n > 0 and c is not null")
    sizes = f.groupBy("n").agg(F.count(F.lit(1)).alias("same")).where("same > 1").select("n")
    marked = f.join(sizes, "n", "left_semi").select("k", F.concat_ws(":", F.col("n").cast("string"), F.sha2(F.col("c").cast("binary"), 256)).alias("g"))
    scratch = Scratch(files.sparkSession, "duplicates")
    marked = scratch.table(marked.groupBy("g", "k").agg(F.lit(1).alias("one")).drop("one"), "marked")  # keys and fingerprints
    groups = marked.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.min("k").alias("first")).where("members > 1")
    groups = scratch.table(groups.select("g", "members", F.struct("members", "first").alias("facts")), "groups")
    rows = lookup(marked.withColumn("key", F.col("g")), "key", groups, "g", "facts", "members", rows_of(marked), "facts")
    return rows.select(F.col("g").alias("group"), F.col("k").alias(key), "facts.members", "facts.first")


def duplicate_groups(files: DataFrame, key: str, size: str, content: str) -> DataFrame:
    """One row per group: fingerprint, number of files, first key, bytes that its copies take."""
    m = duplicate_members(files, key, size, content)
    return m.groupBy("group").agg(F.max("members").alias("members"), F.min("first").alias("first"), (F.split(F.col("group"), ":")[0].cast("long") * (F.max("members") - 1)).alias("redundant_bytes"))


def duplicate_pairs(files: DataFrame, key: str, size: str, content: str, most: int = 200) -> DataFrame:
    """Pairs ``a`` before ``b`` of duplicate files.

    Groups of up to ``most`` files give all their pairs, as a pairwise report needs. A larger group of copies gives
    each member's pair with the first one: the same class, without a quadratic number of rows.
    """
    m = duplicate_members(files, key, size, content)
    small = m.where(F.col("members") <= most)
    b = small.select("group", F.col(key).alias("b"))
    full = small.select("group", F.col(key).alias("a")).join(b, "group").where("a < b")
    star = m.where((F.col("members") > most) & (F.col(key) > F.col("first"))).select("group", F.col("first").alias("a"), F.col(key).alias("b"))
    return full.unionByName(star).select("group", "a", "b", F.lit("identical_file").alias("relation"), F.lit(1.0).alias("symmetric_similarity"))


def redundant_copies(files: DataFrame, key: str, size: str, content: str) -> DataFrame:
    """All members of duplicate groups but the first of each."""
    return duplicate_members(files, key, size, content).where(F.col(key) > F.col("first")).select("group", key)
