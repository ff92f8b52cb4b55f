"""Reading reports: normalise, deduplicate, filter, sort, page, summarise, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import relation as R
from ..functions import text as T

#: Columns of the two CSV forms.
CSV_COLUMNS = (
    "completed_at", "video_a", "video_b", "a_in_b", "b_in_a", "symmetric_similarity", "avg_similarity_a_to_b", "avg_similarity_b_to_a", "relation",
    "total_frames_a", "total_frames_b", "duration_a", "duration_b", "raw_similarity_max", "raw_similarity_p95", "matched_segment_count",
)
RAW_KEYS = ("analysis_mode", "duplicate_group_paths", "file_size_bytes", "fingerprint", "raw_similarity_max", "raw_similarity_mean", "raw_similarity_p95", "raw_similarity_p99", "preprocess_config", "match_threshold")

# Names under which earlier reports hold a column.
ALIASES = {
    "video_a": ("video_a", "video1"),
    "video_b": ("video_b", "video2"),
    "completed_at": ("completed_at", "finished_at", "timestamp", "created_at", "modified_at"),
    "matched_segment_count": ("matched_segment_count",),
}


def _any(df: DataFrame, names: tuple[str, ...]) -> Column:
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def normalize_pairs(pairs: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Report pairs as the reader shows them.

    Ratios may be percentages, texts may be missing, earlier column names count. Adds ``pair_key``, the unordered
    identity of the two videos (path, else name), and the relation that the ratios and lengths support. Missing
    lengths count as 0; NaN counts as missing.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) if c in pairs.columns else F.lit(None).cast("double")
    text = lambda c: F.coalesce(_any(pairs, ALIASES.get(c, (c,))).cast("string"), F.lit(""))
    path_a = F.coalesce(F.nullif(text("video_a_path"), F.lit("")), text("video_a"))
    path_b = F.coalesce(F.nullif(text("video_b_path"), F.lit("")), text("video_b"))
    a, b = R.normalized_ratio(number("a_in_b")), R.normalized_ratio(number("b_in_a"))
    frames = [F.coalesce(number(f"total_frames_{s}"), F.lit(0.0)) for s in "ab"]
    durations = [F.coalesce(number(f"duration_{s}"), F.lit(0.0)) for s in "ab"]
    reported = F.coalesce(F.nullif(text("relation"), F.lit("")), F.lit("unknown"))
    left, right = T.normalize_path(path_a), T.normalize_path(path_b)
    shown = lambda name, path: F.coalesce(F.nullif(name, F.lit("")), F.nullif(T.basename(path), F.lit("")), F.lit("-"))
    keep = ["pair_id"] if "pair_id" in pairs.columns else []
    return pairs.select(
        *keep, F.concat_ws("||", F.least(left, right), F.greatest(left, right)).alias("pair_key"),
        _any(pairs, ALIASES["completed_at"]).alias("completed_at"),
        shown(text("video_a"), path_a).alias("video_a"), shown(text("video_b"), path_b).alias("video_b"), path_a.alias("video_a_path"), path_b.alias("video_b_path"),
        a.alias("a_in_b"), b.alias("b_in_a"), R.normalized_ratio(number("symmetric_similarity")).alias("symmetric_similarity"),
        R.normalized_ratio(number("avg_similarity_a_to_b")).alias("avg_similarity_a_to_b"), R.normalized_ratio(number("avg_similarity_b_to_a")).alias("avg_similarity_b_to_a"),
        R.normalized_relation(reported, a, b, threshold, *frames, *durations).alias("relation"),
        frames[0].cast("long").alias("total_frames_a"), frames[1].cast("long").alias("total_frames_b"), durations[0].alias("duration_a"), durations[1].alias("duration_b"),
        F.coalesce(number("matched_segment_count"), F.lit(0.0)).cast("long").alias("matched_segment_count"),
        F.coalesce(number("matches_a_to_b_total"), F.lit(0.0)).cast("long").alias("matches_a_to_b_total"), F.coalesce(number("matches_b_to_a_total"), F.lit(0.0)).cast("long").alias("matches_b_to_a_total"),
    )


def pair_completeness(frame_matches: Column, segments: Column, windows: Column) -> Column:
    """How much a normalised pair holds: weighted counts, totals and present ratios."""
    present = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("symmetric_similarity", "a_in_b", "b_in_a")), F.lit(0))
    return frame_matches * 3 + segments * 8 + windows * 2 + F.col("matches_a_to_b_total") + F.col("matches_b_to_a_total") + present


def dedupe_pairs(normalized: DataFrame, order: str = "pair_id", frame_matches: Column | None = None, segments: Column | None = None, windows: Column | None = None) -> DataFrame:
    """One row per unordered pair: the most complete one, the first by ``order`` among equals. A mergeable maximum."""
    zero = F.lit(0)
    score = pair_completeness(zero if frame_matches is None else frame_matches, F.col("matched_segment_count") if segments is None else segments, zero if windows is None else windows)
    rows = normalized.withColumn("completeness", score)
    best = rows.groupBy("pair_key").agg(F.max_by(F.struct(*rows.columns), F.struct("completeness", -F.col(order))).alias("row"))
    return best.select("row.*")


def filter_pairs(normalized: DataFrame, relation: str = "all", query: str = "", threshold: float | None = None) -> DataFrame:
    """Pairs of a class of relations whose names or file names contain ``query``."""
    out = normalized.where(R.relation_matches("relation", relation)) if relation != "all" else normalized
    q = query.strip().lower()
    if q:
        text = F.lower(F.concat_ws(" ", "video_a", "video_b", T.basename("video_a_path"), T.basename("video_b_path")))
        out = out.where(F.contains(text, F.lit(q)))
    return out if threshold is None else out.where(F.col("symmetric_similarity") >= threshold)


# The keys by which reports are sorted.
SORT_KEYS = ("completed_at", "video_a", "video_b", "a_in_b", "b_in_a", "symmetric_similarity", "matched_segment_count", "frame_matches", "relation")


def sort_order(key: str = "symmetric_similarity", descending: bool = True, tie: str = "pair_id") -> list[Column]:
    """The order by one of ``SORT_KEYS``; missing values are the lowest; texts in natural order."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key {key}")
    if key == "relation":
        keys = [R.relation_rank("relation"), T.natural_key(R.relation_label("relation"))]
    elif key == "frame_matches":
        keys = [F.col("matches_a_to_b_total") + F.col("matches_b_to_a_total")]
    else:
        keys = [T.natural_key(key)] if key in ("video_a", "video_b") else [F.col(key)]
    return [*[k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys], F.col(tie).asc()]


def sort_pairs(normalized: DataFrame, key: str = "symmetric_similarity", descending: bool = True, tie: str = "pair_id") -> DataFrame:
    """Sorted by one of ``SORT_KEYS`` (see ``sort_order``)."""
    return normalized.orderBy(*sort_order(key, descending, tie))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1, clamped to what exists) of an ordered frame."""
    rows = df.count()
    pages = max(1, -(-rows // size))
    return df.offset((max(1, min(number, pages)) - 1) * size).limit(size)


def page_numbers(current: int, pages: int, width: int = 3) -> list[int]:
    """The page numbers shown around the current one."""
    first = max(1, min(current - width // 2, pages - width + 1))
    return list(range(first, min(pages, first + width - 1) + 1))


def video_entries(normalized: DataFrame) -> DataFrame:
    """Two rows per pair, one for each side."""
    side = lambda s: F.struct(F.lit(s.upper()).alias("side"), F.col(f"video_{s}").alias("video"), F.col(f"video_{s}_path").alias("path"))
    return normalized.select("pair_key", F.explode(F.array(side("a"), side("b"))).alias("e")).select("pair_key", "e.*")


def summarize_pairs(normalized: DataFrame, threshold: float = 0.65) -> DataFrame:
    """One row: distinct videos, pairs, pairs at or above the threshold, partial relations, segments."""
    score = F.coalesce(F.col("symmetric_similarity"), F.greatest(F.coalesce("a_in_b", F.lit(0.0)), F.coalesce("b_in_a", F.lit(0.0))))
    facts = normalized.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(score >= threshold).alias("high_pairs"), F.count_if(R.is_partial("relation")).alias("partial_pairs"),
        F.coalesce(F.sum("matched_segment_count"), F.lit(0)).alias("segments"),
    )
    entry = F.coalesce(F.nullif("path", F.lit("")), F.nullif("video", F.lit("")))
    videos = video_entries(normalized).select(entry.alias("v")).where("v is not null").agg(F.countDistinct("v").alias("videos"))
    return facts.crossJoin(videos)  # one row each


def relation_histogram(normalized: DataFrame) -> DataFrame:
    return normalized.groupBy("relation").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("pairs"), "relation")


def relation_counters(normalized: DataFrame) -> DataFrame:
    """Counts of the classes that the HTML report shows."""
    r = F.lower("relation")
    return normalized.agg(
        F.count_if(r.contains("near")).alias("near"), F.count_if(r.contains("clip")).alias("clip"), F.count_if(r.contains("partial")).alias("partial"), F.count_if(r == "different").alias("different")
    )


def normalize_matches(matches: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Matches of both directions at or above a threshold, as A and B columns, whatever the direction.

    Similarities above 1 are percentages. ``frame_a``/``frame_b`` and ``ts_a``/``ts_b`` swap sides for ``B_to_A``.
    """
    m = matches.withColumn("similarity", R.normalized_ratio("similarity")).where(F.col("similarity") >= threshold)
    forward = F.col("direction") == "A_to_B"
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    return m.select(
        "match_id", "pair_id", "direction", pick("source_frame_index", "target_frame_index").alias("frame_a"), pick("target_frame_index", "source_frame_index").alias("frame_b"),
        pick("source_timestamp", "target_timestamp").alias("ts_a"), pick("target_timestamp", "source_timestamp").alias("ts_b"), "similarity",
    )


def top_matches(matches: DataFrame, limit: int = 240, keys: tuple[str, ...] = ("pair_id", "direction"), tie: str = "match_id") -> DataFrame:
    """The ``limit`` best matches of each pair and direction, with ``total``, the number of all of them."""
    totals = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("similarity").desc_nulls_last(), tie))
    top = matches.withColumn("rank", rn).where(F.col("rank") <= limit)
    return top.join(totals, list(keys))


def dedupe_windows(windows: DataFrame) -> DataFrame:
    """Each window of a pair once, by direction and ranges."""
    keys = [c for c in ("pair_id", "direction", "source_start", "source_end", "best_target_start", "best_target_end") if c in windows.columns]
    return windows.dropDuplicates(keys)


def pair_rows(pairs: DataFrame, segments: DataFrame, windows: DataFrame, matches: DataFrame, key: str = "pair_id", limit: int = 240) -> DataFrame:
    """Report rows: pairs with their segments, windows by direction and truncated matches as nested arrays."""
    s = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in segments.columns if c != key]))).alias("segments"))
    w = dedupe_windows(windows)
    w = w.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in w.columns if c != key]))).alias("windows"))
    top = top_matches(matches, limit)
    entry = F.struct("rank", "source_frame_index", "target_frame_index", "source_timestamp", "target_timestamp", "similarity")
    m = top.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("direction") == "A_to_B", entry))).alias("matches_a_to_b"), F.sort_array(F.collect_list(F.when(F.col("direction") == "B_to_A", entry))).alias("matches_b_to_a")
    )
    return pairs.join(s, key, "left").join(w, key, "left").join(m, key, "left")


def delete_pairs(normalized: DataFrame, doomed: DataFrame) -> DataFrame:
    """Pairs without those of ``doomed`` (``video_a_path``, ``video_b_path``, either order)."""
    a, b = T.normalize_path("video_a_path"), T.normalize_path("video_b_path")
    keys = doomed.select(F.concat_ws("||", F.least(a, b), F.greatest(a, b)).alias("pair_key")).distinct()
    return normalized.join(keys, "pair_key", "left_anti")


def unique_non_empty(df: DataFrame, column: str, order: str) -> DataFrame:
    """The distinct values of a text column without outer blanks, blank ones dropped, in order of their first row."""
    x = df.select(F.trim(F.col(column)).alias(column), F.col(order).alias("__at")).where(F.col(column) != "")
    return x.groupBy(column).agg(F.min("__at").alias("__at")).orderBy("__at", column).select(column)


def delete_pairs_checked(normalized: DataFrame, doomed: DataFrame) -> DataFrame:
    """As ``delete_pairs``, but it is an error if nothing was removed."""
    left = delete_pairs(normalized, doomed)
    if left.count() == normalized.count():
        raise ValueError("no pair of the report matches")
    return left


def compact_raw(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in RAW_KEYS if c in df.columns])


def merge_reports(reports: DataFrame) -> DataFrame:
    """The latest report of every key, latest first; reports without a JSON or CSV path don't count."""
    r = reports.where(F.coalesce("json_path", "csv_path").isNotNull() & (F.trim("report_key") != ""))
    last = r.groupBy("report_key").agg(F.max_by(F.struct(*r.columns), F.struct(F.coalesce("modified_ms", F.lit(-1)), "json_path", "csv_path")).alias("row"))
    return last.select("row.*").orderBy(F.col("modified_ms").desc_nulls_last(), "report_key")
