"""Selecting and sorting scanned files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Units of the filters.
SIZE_UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4}
DURATION_UNITS = {"ms": 0.001, "second": 1.0, "minute": 60.0, "hour": 3600.0}


@dataclass(frozen=True)
class ScanFilter:
    """A clause is active if its key is enabled and its bound is above 0 or not blank."""

    enabled: frozenset[str] = frozenset()
    min_size: float = 0
    max_size: float = 0
    size_unit: str = "gb"
    name_prefixes: str = ""
    name_includes: str = ""
    extensions: str = ""
    min_duration: float = 0
    max_duration: float = 0
    duration_unit: str = "second"
    min_fps: float = 0
    max_fps: float = 0
    min_width: float = 0
    max_width: float = 0
    min_height: float = 0
    max_height: float = 0
    sort_by: str = "name"
    descending: bool = False
    extra: dict = field(default_factory=dict)

    def needs_metadata(self) -> bool:
        return bool(self.metadata_bounds()) or self.sort_by in ("duration", "fps", "resolution")

    def metadata_bounds(self) -> list[tuple[str, float, float]]:
        unit = DURATION_UNITS[self.duration_unit]
        bounds = []
        if "duration" in self.enabled:
            bounds.append(("duration", self.min_duration * unit, self.max_duration * unit))
        if "fps" in self.enabled:
            bounds.append(("fps", self.min_fps, self.max_fps))
        if "resolution" in self.enabled:
            bounds += [("width", self.min_width, self.max_width), ("height", self.min_height, self.max_height)]
        return [b for b in bounds if b[1] > 0 or b[2] > 0]


def words(text: str) -> list[str]:
    """Lower-case words of a filter field."""
    return [w.lower() for w in re.split(r"[\s,;，；、]+", text) if w]


def _within(c: Column, lo: float, hi: float) -> Column:
    out = F.lit(True)
    if lo > 0:
        out = out & (c >= lo)
    if hi > 0:
        out = out & (c <= hi)
    return out


def _any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def filter_scan(videos: DataFrame, f: ScanFilter, metadata: DataFrame | None = None) -> DataFrame:
    """Files that meet every active clause.

    ``videos``: ``path``, ``name``, ``extension``, ``size_bytes``. Clauses on name, size and extension come first;
    ``metadata`` (``path``, ``readable``, ``duration``, ``fps``, ``width``, ``height``) is joined by normalised path
    only where a clause needs it; unreadable or missing metadata then excludes a file. Null values meet no clause.
    """
    keep = F.lit(True)
    if "size" in f.enabled:
        unit = SIZE_UNITS[f.size_unit]
        keep = keep & _within(F.col("size_bytes"), f.min_size * unit, f.max_size * unit)
    if "name" in f.enabled:
        name = F.lower("name")
        if words(f.name_prefixes):
            keep = keep & _any_of([name.startswith(w) for w in words(f.name_prefixes)])
        if words(f.name_includes):
            keep = keep & _any_of([F.contains(name, F.lit(w)) for w in words(f.name_includes)])
    if "extension" in f.enabled and words(f.extensions):
        keep = keep & F.lower(F.regexp_replace("extension", r"^\.", "")).isin(*[w.removeprefix(".") for w in words(f.extensions)])
    out = videos.where(keep)
    if metadata is not None and f.metadata_bounds():
        ok = F.col("readable")
        for name, lo, hi in f.metadata_bounds():
            ok = ok & _within(F.col(name), lo, hi)
        good = metadata.where(ok).select(T.normalize_path("path").alias("__p")).distinct()
        out = out.withColumn("__p", T.normalize_path("path")).join(good, "__p", "left_semi").drop("__p")
    return out


def join_metadata(videos: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files with the metadata of the same normalised path, nulls where there is none; ``metadata`` has each path once."""
    m = metadata.withColumn("__p", T.normalize_path("path")).drop("path")
    return videos.withColumn("__p", T.normalize_path("path")).join(m, "__p", "left").drop("__p")


def scan_order(by: str = "name", descending: bool = False) -> list[Column]:
    """The order by name, size, modified, duration, fps or resolution, then name and path.

    Files without readable metadata come last in either direction when sorted by metadata.
    """
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    keys = {"name": [T.natural_key("name")], "size": ["size_bytes"], "modified": ["modified_at_ms"], "duration": ["duration"], "fps": ["fps"]}
    chosen = [F.col("width") * F.col("height"), F.col("width"), F.col("height")] if by == "resolution" else [F.col(c) if isinstance(c, str) else c for c in keys[by]]
    first = []
    if by in ("duration", "fps", "resolution"):
        first = [F.coalesce("readable", F.lit(False)).desc()]
        chosen = [F.when(F.col("readable"), c) for c in chosen]
    return [*first, *[turn(c) for c in chosen], T.natural_key("name").asc(), T.natural_key("path").asc()]


def sort_scan(videos: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """Sorted as ``scan_order`` says."""
    return videos.orderBy(*scan_order(by, descending))


def explicit_list(paths: DataFrame, files: DataFrame, quarantine: str = "") -> DataFrame:
    """Files of a list of paths: blanks dropped, each normalised path once, none below ``quarantine``, sorted by name."""
    wanted = paths.select(F.trim("path").alias("path")).where("path <> ''").select(T.normalize_path("path").alias("__p")).distinct()
    out = files.withColumn("__p", T.normalize_path("path")).join(wanted, "__p", "left_semi").dropDuplicates(["__p"])
    if quarantine:
        out = out.where(~T.is_child_path(T.normalize_path(F.lit(quarantine)), "__p"))
    return out.drop("__p").orderBy(F.lower("name"), "path")


def task_videos(paths: DataFrame, records: DataFrame) -> DataFrame:
    """Paths with the size and time that a task recorded for them, 0 where it has none."""
    r = records.select(T.normalize_path("path").alias("__p"), "size", "mtime_ms").dropDuplicates(["__p"])
    j = paths.withColumn("__p", T.normalize_path("path")).join(r, "__p", "left")
    size = F.coalesce("size", F.lit(0))
    return j.select("path", T.basename("path").alias("name"), T.extension("path").alias("extension"), size.alias("size_bytes"), (size / 1024 / 1024).alias("size_mb"), F.coalesce("mtime_ms", F.lit(0)).alias("modified_at_ms"))


def scan_summary(videos: DataFrame) -> DataFrame:
    return videos.agg(F.count(F.lit(1)).alias("videos"), F.coalesce(F.sum("size_mb"), F.lit(0.0)).alias("total_mb"))
