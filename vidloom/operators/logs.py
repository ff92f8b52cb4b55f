"""Decoder logs: validation, filtering, running summaries and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .running import running

# What lines say, and how many of them each tolerance accepts.
FATAL = ("Error opening input", "Invalid data found when processing input", "moov atom not found", "does not contain any stream", "matches no streams")
SEVERE = ("Invalid NAL unit size", "Error splitting the input into NAL units")
MISSING = "missing picture in access unit"
TOLERANCES = {"strict": (5, 20), "balanced": (20, 100), "lenient": (200, 1000), "failure_only": (None, None)}
DECODE_FAILURES = ("cannot open video", "decoded no usable frames", "no frames retained", "error splitting the input", "invalid nal unit", "failed to decode", "unable to decode", "decord")
IMPORTANT_STARTS = ("warning:", "error:", "traceback")
IMPORTANT_PARTS = ("failed to index", "failed to compare", "failed to process", "cannot open video", "no frames retained", "exception", "失败", "错误", "无法打开")
HIDDEN_STARTS = ("Loading weights:", "ANALYSIS_VIDEO_CONTEXT|", "ANALYSIS_VIDEO_QUARANTINED|", "[transformers]", "Key", "----", "Notes:")
HIDDEN_PARTS = ("UNEXPECTED", "can be ignored when loading", "requires torchvision", "HF_TOKEN", "unauthenticated requests to the HF Hub")
SEEK_WARNING = ("video_reader.cc:711", "Failed to skip frames effectively", "Decoder did not respond after 10000 attempts")
SUMMARY_FIRST, SUMMARY_EVERY, SUMMARY_SEVERE = 100, 1000, 20


def _has(line: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(line, F.lit(p))
    return out


def _all(line: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.contains(line, F.lit(p))
    return out


def is_important(line: Column | str) -> Column:
    low = F.lower(F.trim(F.col(line) if isinstance(line, str) else line))
    starts = F.lit(False)
    for p in IMPORTANT_STARTS:
        starts = starts | low.startswith(p)
    return starts | _has(low, IMPORTANT_PARTS)


def is_noise(line: Column | str) -> Column:
    """Scaler warnings and seek warnings of the decoder."""
    c = F.col(line) if isinstance(line, str) else line
    return _all(c, ("swscaler", "Slice parameters", "invalid")) | _all(c, ("deprecated pixel format used", "swscaler")) | _all(c, SEEK_WARNING)


def is_hidden(line: Column | str) -> Column:
    """Lines that the log view leaves out; an important line never is."""
    c = F.trim(F.col(line) if isinstance(line, str) else line)
    starts = F.lit(False)
    for p in HIDDEN_STARTS:
        starts = starts | c.startswith(p)
    return (c == "") | (~is_important(c) & (starts | _has(c, HIDDEN_PARTS) | is_noise(c)))


def is_decode_failure(error: Column | str) -> Column:
    return _has(F.lower(F.col(error) if isinstance(error, str) else error), DECODE_FAILURES)


def limit_of(custom: int | None, preset: int | None) -> int | None:
    """A custom limit of 0 or less means unlimited; none means the preset's."""
    return preset if custom is None else max(1, custom) if custom > 0 else None


def validate_streams(lines: DataFrame, tolerance: str = "balanced", severe_limit: int | None = None, missing_limit: int | None = None, video: str = "video", line: str = "line", order: str = "line_no") -> DataFrame:
    """``video``, ``severe``, ``missing``, ``verdict`` (null: accepted) of the error lines of every video.

    A fatal line decides at once; else the first limit that is reached in order of the lines does, and lines after
    it don't count. Blank lines don't count. Counting is a running sum that may cross tasks, so a log of any length is
    spread; the verdict is an aggregate.
    """
    preset = TOLERANCES.get(tolerance, TOLERANCES["balanced"])
    s_max, m_max = limit_of(severe_limit, preset[0]), limit_of(missing_limit, preset[1])
    c = F.trim(F.col(line))
    rows = lines.where(c != "").select(F.col(video).alias("video"), F.col(order).alias("n"), c.alias("line"))
    fatal, severe = _has(F.col("line"), FATAL), _has(F.col("line"), SEVERE)
    rows = rows.withColumn("kind", F.when(fatal, "f").when(severe, "s").when(F.contains(F.col("line"), F.lit(MISSING)), "m").otherwise("o"))
    rows = rows.where("kind <> 'o'").unionByName(rows.where("kind = 'o'").groupBy("video").agg(F.min("n").alias("n"), F.min("line").alias("line"), F.lit("o").alias("kind")))
    one = lambda k: F.when(F.col("kind") == k, 1).otherwise(0).cast("long")
    rows = running(rows, ["video"], ["n"], {"s": one("s"), "m": one("m")})
    stop = F.col("kind") == "f"
    if s_max:
        stop = stop | (F.col("s") >= s_max)
    if m_max:
        stop = stop | (F.col("m") >= m_max)
    ends = F.min(F.when(stop, F.struct("n", "kind", "s", "m", "line")))
    first = F.min(F.when(F.col("kind") == "s", F.struct("n", "line")))
    x = rows.groupBy("video").agg(ends.alias("e"), first.alias("first"), F.max("s").alias("s_all"), F.max("m").alias("m_all"))
    s, m = F.coalesce("e.s", "s_all"), F.coalesce("e.m", "m_all")
    verdict = F.when(F.col("e.kind") == "f", T.compact_error("e.line"))
    if s_max:
        verdict = verdict.when(s >= s_max, F.concat(T.compact_error("first.line"), F.format_string("; %d severe stream errors", s)))
    if m_max:
        verdict = verdict.when(m >= m_max, F.format_string("%d missing pictures", m))
    return x.select("video", s.alias("severe"), m.alias("missing"), verdict.alias("verdict"))


def with_context(lines: DataFrame, stream: str, order: str, marker: Column) -> DataFrame:
    """Adds ``context``, the last marker at or before each line, and ``episode``, its running number (0: before any)."""
    return running(lines, [stream], [order], {"episode": F.when(marker.isNotNull(), 1).otherwise(0).cast("long")}, lasts={"context": marker})


def warning_summaries(lines: DataFrame, stream: str = "stream", order: str = "line_no", line: str = "line", context: str = "context", episode: str = "episode") -> DataFrame:
    """Summaries of decoder warnings of each context, as they are emitted.

    Running totals are emitted at 100 and at every 1,000 warnings; a context that ends with warnings not yet
    reported has a last summary if it has at least 100 of them, or at least 20 that aren't missing pictures.
    """
    keys = [stream, episode]
    c = F.col(line)
    rows = lines.select(*keys, order, context, F.contains(c, F.lit(SEVERE[0])).alias("nal"), F.contains(c, F.lit(MISSING)).alias("miss"))
    one = lambda x: F.when(x, 1).otherwise(0).cast("long")
    nal, miss = F.col("nal"), F.col("miss")
    run = running(rows, keys, [order], {"invalid_nal": one(nal), "missing_picture": one(miss & ~nal), "other": one(~nal & ~miss), "total": F.lit(1).cast("long")}).drop("nal", "miss")
    due = (F.col("total") == SUMMARY_FIRST) | (F.col("total") % SUMMARY_EVERY == 0)
    live = run.where(due).withColumn("kind", F.lit("running"))
    last = run.groupBy(*keys).agg(F.max_by(F.struct(*run.columns), "total").alias("r")).select("r.*")
    severe = F.col("invalid_nal") + F.col("other")
    final = last.where(~due & ((F.col("total") >= SUMMARY_FIRST) | (severe >= SUMMARY_SEVERE))).withColumn("kind", F.lit("final"))
    return live.unionByName(final).drop(order)


def parse_context(line: Column | str) -> Column:
    """``path`` and ``phase`` of a context line; null for any other line, broken JSON or a blank path."""
    return _payload(line, "ANALYSIS_VIDEO_CONTEXT|", "path string, phase string", ("path", "phase"), "path")


def parse_quarantined(line: Column | str) -> Column:
    """What a quarantine line says: paths, how many videos are left and gone, whether the file was moved; else null."""
    ddl = "originalPath string, destinationPath string, remainingVideos bigint, removedVideos bigint, moved boolean"
    return _payload(line, "ANALYSIS_VIDEO_QUARANTINED|", ddl, tuple(x.split()[0] for x in ddl.split(", ")))


def _payload(line: Column | str, prefix: str, ddl: str, needed: tuple[str, ...], filled: str | None = None) -> Column:
    c = F.trim(F.col(line) if isinstance(line, str) else line)
    x = F.from_json(F.substring(c, len(prefix) + 1, 2**31 - 1), ddl)
    ok = c.startswith(prefix)
    for n in needed:
        ok = ok & x[n].isNotNull()
    if filled:
        ok = ok & (F.trim(x[filled]) != "")
    return F.when(ok, x)


def route(line: Column | str) -> Column:
    """Where a line goes: the first rule that matches."""
    c = F.col(line) if isinstance(line, str) else line
    return (
        F.when(c.startswith("ANALYSIS_VIDEO_CONTEXT|"), "context").when(F.contains(c, F.lit("[h264 @")), "warning").when(c.startswith("ANALYSIS_VIDEO_QUARANTINED|"), "quarantine")
        .when(T.parse_progress(c).isNotNull(), "progress").when(is_hidden(c), "hidden").otherwise("log")
    )


def monotone_progress(df: DataFrame, stream: str, order: list[str], progress: str) -> DataFrame:
    """Adds ``shown``: progress never falls, and stays below 100 until it is 100."""
    top = F.col("__top")
    rows = running(df, [stream], order, tops={"__top": F.least(F.greatest(F.col(progress), F.lit(0.0)), F.lit(100.0))})
    return rows.withColumn("shown", F.when(top < 100, F.least(top, F.lit(99.99))).otherwise(top)).drop("__top")


def tail(lines: DataFrame, stream: str, order: list[str], n: int = 1000) -> DataFrame:
    """The last ``n`` lines of every stream."""
    w = W.partitionBy(stream).orderBy(*[F.col(o).desc() for o in order])
    return lines.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
