"""Numbered feature cache profiles: which folder of a video holds the features of given settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a sidecar may say.
SIDECAR = "profile_key string, profileKey string, suffix string, skip_threshold double, max_gap_sec double, frame_step int"


def profile_of(suffix: Column, skip: Column, gap: Column, step: Column) -> Column:
    """The key of a profile; parts that aren't stated are left out, an empty suffix is ``default``."""
    name = F.coalesce(F.nullif(F.regexp_replace(suffix, "^_+", ""), F.lit("")), F.lit("default"))
    parts = [F.concat(F.lit("skip_"), T.cache_float(skip)), F.concat(F.lit("gap_"), T.cache_float(gap), F.lit("s")), F.concat(F.lit("step_"), F.greatest(F.lit(1), step).cast("string"))]
    said = [F.when(c.isNotNull(), p) for c, p in zip((skip, gap, step), parts)]
    return F.concat_ws("__", name, *said)


def sidecars(folders: DataFrame, key: str = "profile_key") -> DataFrame:
    """``folders`` with ``sidecar``: the JSON text of the profile that ``key`` names, as written beside its features."""
    doc = F.struct(F.lit(1).alias("version"), F.col("directory").cast("string").alias("directory"), F.lit("frame_features.npz").alias("cache_file"), F.col(key).alias("profile_key"), F.substring(F.sha1(F.col(key)), 1, 16).alias("profile_hash"))
    return folders.withColumn("sidecar", F.to_json(doc))


def locate_profiles(wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """``video``, ``profile_key``, ``directory``, ``source`` for each wanted profile of a video.

    ``wanted``: ``video``, ``profile_key``; ``folders``: ``video``, ``directory``, ``sidecar`` (JSON text or null) and
    ``complete`` (features are there). The first of: the smallest numbered folder whose sidecar names the key, or whose
    settings make it (``numbered``); a folder called after the key, or another unnumbered one with such a sidecar, if it
    has features (``legacy``); the smallest positive number that the video doesn't use (``new``). Sidecars that can't be
    read match nothing; each video and key counts once; videos without folders start at 1. Wanted keys of one video that
    have no folder yet get numbers one after another, in order of the key.
    """
    f = folders.where("video is not null and directory is not null").select("video", F.col("directory").cast("string").alias("directory"), F.from_json("sidecar", SIDECAR).alias("s"), F.coalesce("complete", F.lit(False)).alias("complete"), F.col("sidecar").isNotNull().alias("told"))
    explicit = F.coalesce("s.profile_key", "s.profileKey")
    readable = F.col("told") & F.coalesce("s.profile_key", "s.profileKey", "s.suffix", F.col("s.skip_threshold").cast("string"), F.col("s.max_gap_sec").cast("string"), F.col("s.frame_step").cast("string")).isNotNull()
    made = profile_of(F.coalesce("s.suffix", F.lit("")), F.col("s.skip_threshold"), F.col("s.max_gap_sec"), F.col("s.frame_step"))
    keys = F.array_distinct(F.array_compact(F.array(explicit, F.when(readable, made))))
    f = f.withColumn("number", F.when(F.col("directory").rlike("^[0-9]+$"), F.col("directory").try_cast("long"))).withColumn("keys", keys)
    w = wanted.where("video is not null and profile_key is not null").select("video", "profile_key").distinct()
    own_name = T.safe_name("profile_key")
    rank = F.when(F.col("number").isNotNull() & F.array_contains("keys", F.col("profile_key")), F.struct(F.lit(0).alias("r"), F.col("number").alias("n"), F.col("directory")))
    rank = rank.when(F.col("number").isNull() & F.col("complete") & (F.col("directory") == own_name), F.struct(F.lit(1).alias("r"), F.lit(0).cast("long").alias("n"), F.col("directory")))
    rank = rank.when(F.col("number").isNull() & F.col("complete") & F.array_contains("keys", F.col("profile_key")), F.struct(F.lit(2).alias("r"), F.lit(0).cast("long").alias("n"), F.col("directory")))
    hit = w.join(f, "video", "left").groupBy("video", "profile_key").agg(F.min(rank).alias("hit"))
    used = f.groupBy("video").agg(F.array_distinct(F.array_compact(F.collect_list("number"))).alias("used"))
    new = hit.where("hit is null").groupBy("video").agg(F.array_sort(F.collect_list("profile_key")).alias("new")).join(used, "video", "left")
    free = F.array_except(F.sequence(F.lit(1).cast("long"), F.size("new") + F.size(F.coalesce("used", F.array().cast("array<bigint>")))), F.coalesce("used", F.array().cast("array<bigint>")))
    new = new.select("video", F.explode(F.arrays_zip("new", F.slice(free, 1, F.size("new")).alias("free"))).alias("x")).select("video", F.col("x.new").alias("profile_key"), F.col("x.free").cast("string").alias("directory"), F.lit("new").alias("source"))
    old = hit.where("hit is not null").select("video", "profile_key", F.col("hit.directory").alias("directory"), F.when(F.col("hit.r") == 0, "numbered").otherwise("legacy").alias("source"))
    return old.unionByName(new)
