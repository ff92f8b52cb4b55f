"""Joins: lookups that survive hot keys, and joins in which null keys are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from a thousandth of all rows on, so at most this many keys are hot.
HOT_KEYS = 1000


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, weight: str, total: int, out: str, small: int = 1_000_000) -> DataFrame:
    """Replace ``df[key]`` by ``table[value]``, named ``out``; inner semantics.

    ``table`` holds each key once with its ``weight``, the number of rows of ``df`` that may carry it; the
    weights sum to ``total``. Keys above ``total / HOT_KEYS`` (never more than HOT_KEYS of them, whatever the
    size of the data) are broadcast, so their rows are not shuffled at all; all others go through an ordinary
    join in which no key has more than a thousandth of the rows.
    """
    t = table.select(F.col(table_key).alias("__k"), F.col(value).alias("__v"), F.col(weight).alias("__w"))
    kept = [c for c in df.columns if c != key]

    def joined(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side, F.col(key) == F.col("__k"), "inner").select(*kept, F.col("__v").alias(out))

    if total <= small:
        return joined(df, t)
    hot = F.broadcast(t.where(F.col("__w") * HOT_KEYS > total))
    cold = t.where(F.col("__w") * HOT_KEYS <= total)
    rest = df.join(hot.select("__k"), F.col(key) == F.col("__k"), "left_anti")
    return joined(df, hot).unionByName(joined(rest, cold))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """All columns of ``left`` and the others of ``right``; null keys are equal. Both sides may come from one frame."""
    others = [c for c in right.columns if c not in keys]
    r = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *others)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    joined = left.join(r, cond, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"__r{i}" for i in range(len(keys))])
