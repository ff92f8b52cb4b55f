"""Identities of videos, sources and relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def video_identity(path: Column | str) -> Column:
    """Path without outer spaces and trailing slashes, ``\\`` read as ``/``, lower case.

    Null, blank or slash-only paths give null: they identify nothing.
    """
    cleaned = F.lower(F.rtrim(F.replace(F.trim(_c(path)), F.lit("\\"), F.lit("/")), F.lit("/")))
    return F.when(F.length(F.trim(cleaned)) > 0, cleaned)


def relation_code(relation: Column | str) -> Column:
    """Relation without outer spaces, lower case, ``-`` and inner spaces read as ``_``."""
    return F.translate(F.lower(F.trim(_c(relation))), "- ", "__")


def source_code(source: Column | str) -> Column:
    """Source without outer spaces, lower case, ``-`` and inner spaces read as ``_``."""
    return F.translate(F.lower(F.trim(_c(source))), "- ", "__")


def usable(x: Column | str) -> Column:
    """The value where it is a number above 0, else null (null, NaN, zero, negative)."""
    c = _c(x)
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & (c > 0), c)
