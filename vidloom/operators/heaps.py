"""The best k values of a group as a mergeable aggregate."""

from __future__ import annotations

from pyspark.sql import Column


def best_k(value: Column, k: int, smallest: bool = False) -> Column:
    """Array of the ``k`` greatest (or smallest) values of a group, best first; nulls don't count.

    A heap of at most ``k`` values per group is filled before the shuffle and merged after it. This is Spark's own
    aggregate; PySpark keeps it in an internal module, which is why it is used here only and the project file names the
    versions that have it.
    """
    from pyspark.sql.internal import InternalFunction

    return InternalFunction.collect_top_k(value, k, smallest)
