"""Vector and hash functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column | str) -> Column:
    """The vector divided by its norm; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def hash_long(phash: Column | str) -> Column:
    """A 16-digit hex hash as its 64 bits; null for anything else."""
    c = F.lower(F.trim(_c(phash)))
    return F.when(c.rlike("^[0-9a-f]{16}$"), F.conv(c, 16, -10).cast("long"))


def hash_similarity(a: Column | str, b: Column | str) -> Column:
    """1 minus the share of differing bits of two 64-bit hashes given as longs."""
    return 1 - F.bit_count(_c(a).bitwiseXOR(_c(b))) / F.lit(64.0)


def item_or_null(items: Column | str, index: Column | int) -> Column:
    """Item at a 0-based position, null where there is none."""
    return F.get(_c(items), F.lit(index) if isinstance(index, int) else index)
