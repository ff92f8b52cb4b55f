"""Files as rows: scans, catalogues, inventories and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import Scratch

# Extensions that count as videos.
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "flv", "webm", "wmv")
SCHEMA = "path string, name string, extension string, size_bytes bigint, size_mb double, modified_at_ms bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = VIDEO_EXTENSIONS, recursive: bool = True, strict: bool = False) -> DataFrame:
    """Files below ``root`` by name: path, name, extension, size, time.

    The content column is pruned, so no file is opened. A missing root gives no rows, or an error if ``strict``;
    files that vanish during the scan are skipped. Extensions are compared in lower case.
    """
    if not _exists(spark, root):
        if strict:
            raise FileNotFoundError(root)
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    out = files.select("path", T.basename("path").alias("name"), T.extension("path").alias("extension"), F.col("length").alias("size_bytes"), (F.col("length") / 1048576).alias("size_mb"), F.unix_millis("modificationTime").alias("modified_at_ms"))
    if extensions is not None:
        out = out.where(F.col("extension").isin(*extensions))
    return out.orderBy("name", "path")


def walk_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = VIDEO_EXTENSIONS, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """As ``scan_files``, for a mounted folder whose parts may be unreadable: the files, and what was skipped with its error.

    Folders are listed level by level, those of a level by all tasks. Symbolic links are skipped; a folder or entry that
    can't be read costs only itself. The mount must be the same on all executors.
    """
    scratch = Scratch(spark, "walk")

    def look(batches):  # noqa: ANN001, ANN202
        import os

        import pandas as pd

        for x in batches:
            out = []
            for folder in x["path"]:
                try:
                    entries = list(os.scandir(folder))
                except OSError as e:
                    out.append((folder, "error", None, None, str(e)))
                    continue
                for e in entries:
                    try:
                        if not e.is_symlink() and e.is_dir(follow_symlinks=False):
                            out.append((e.path, "folder", None, None, None))
                        elif not e.is_symlink() and e.is_file(follow_symlinks=False):
                            st = e.stat(follow_symlinks=False)
                            out.append((e.path, "file", st.st_size, st.st_mtime_ns // 1_000_000, None))
                    except OSError as err:
                        out.append((e.path, "error", None, None, str(err)))
            yield pd.DataFrame(out, columns=["path", "kind", "size", "at", "error"]).astype({"size": "Int64", "at": "Int64"})

    level, seen = spark.createDataFrame([(root,)], "path string"), None
    while level is not None:
        found = scratch.table(level.mapInPandas(look, "path string, kind string, size bigint, at bigint, error string"), "level")
        seen = found if seen is None else seen.unionAll(found)
        level = found.where("kind = 'folder'").select("path")
        level = level.repartition(spark.sparkContext.defaultParallelism) if recursive and not level.isEmpty() else None
    size, ext = F.col("size").alias("size_bytes"), T.extension("path").alias("extension")
    files = seen.where("kind = 'file'").select("path", T.basename("path").alias("name"), ext, size, (F.col("size") / 1048576).alias("size_mb"), F.col("at").alias("modified_at_ms"))
    if extensions is not None:
        files = files.where(F.col("extension").isin(*extensions))
    return files.orderBy("name", "path"), seen.where("kind = 'error'").select("path", "error")


def explicit_files(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    """One row per path with an ``error`` where it is missing or of another kind."""
    # Folders are asked for, not files: there are far fewer, and what is in them is listed by Spark.
    folders = [f for f in sorted({p.rpartition("/")[0] or "/" for p in paths}) if _exists(spark, f)]
    found = spark.createDataFrame([], "p string, size_bytes bigint")
    if folders:
        listed = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(folders)
        found = listed.select(F.regexp_replace("path", "^file:/+", "/").alias("p"), F.col("length").alias("size_bytes")).distinct()
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    j = asked.join(found, asked["path"] == found["p"], "left")
    error = F.when(F.col("p").isNull(), "not a file").when(~T.extension("path").isin(*extensions), "unsupported extension")
    return j.select("path", T.basename("path").alias("name"), T.extension("path").alias("extension"), "size_bytes", error.alias("error"))


def report_catalogue(files: DataFrame) -> DataFrame:
    """Reports as groups of files that share a stem: formats, total size, latest time, preferred path; latest first."""
    f = files.where(F.lower("extension").isin("json", "csv", "html")).withColumn("report_key", T.stem("path")).withColumn("folder", F.regexp_replace("path", r"[^/]*$", ""))
    path_of = lambda e: F.max(F.when(F.lower("extension") == e, F.col("path")))
    g = f.groupBy("folder", "report_key").agg(
        F.sum("size_bytes").alias("size_bytes"), F.max("modified_at_ms").alias("modified_ms"), F.array_sort(F.collect_set(F.lower("extension"))).alias("formats"),
        path_of("json").alias("json_path"), path_of("csv").alias("csv_path"), path_of("html").alias("html_path"),
    )
    return g.withColumn("path", F.coalesce("json_path", "csv_path", "html_path")).orderBy(F.desc("modified_ms"), "report_key")


def inventory(files: DataFrame) -> DataFrame:
    """Size and number of cache files by category and name, with subtotals and the total (nulls), from one pass.

    ``files``: ``category``, ``name``, ``size_bytes``.
    """
    return files.rollup("category", "name").agg(F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("entries"), F.grouping_id().alias("level")).orderBy("category", "name", "level")


# What a file of the cache is called.
CACHE_EXTENSIONS = ("npz", "npy", "json", "jsonl", "db", "sqlite", "parquet")


def is_cache_file(name: str):  # noqa: ANN201
    return T.extension(name).isin(*CACHE_EXTENSIONS)


def probe_durations(lines: DataFrame, video: str = "video", text: str = "text") -> DataFrame:
    """Duration (at least 0.01 s), size and audio of each video, from the report of a media tool."""
    t = F.col(text)
    num = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit("")).cast("double")
    d = r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)"
    seconds = num(d, 1) * 3600 + num(d, 2) * 60 + num(d, 3)
    size = r"Video:.*?\b(\d{2,5})x(\d{2,5})\b"
    return lines.select(video, F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.01)).alias("duration"), num(size, 1).cast("int").alias("width"), num(size, 2).cast("int").alias("height"), t.rlike(r"Stream #.*Audio:").alias("has_audio"))


def frame_counts(probes: DataFrame) -> DataFrame:
    """Frame count of a probe: as counted, else from duration and rate, else what a decoder said, else 1."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("long"))
    derived = F.when((F.col("duration") > 0) & (F.col("fps") > 0), F.round(F.col("duration") * F.col("fps")).cast("long"))
    return probes.withColumn("frame_count", F.coalesce(positive("nb_frames"), F.when(derived > 0, derived), positive("decoder_frames"), F.lit(1)))


def video_metadata(probes: DataFrame) -> DataFrame:
    """Metadata rows: duration from frames and rate; an unreadable file has zeros and an error text."""
    ok = (F.col("frames") > 0) & (F.col("width") > 0) & F.col("error").isNull()
    zero = lambda c: F.when(ok, F.col(c)).otherwise(0)
    return probes.select(
        "path", ok.alias("readable"), zero("width").alias("width"), zero("height").alias("height"), zero("fps").cast("double").alias("fps"), zero("frames").cast("long").alias("frame_count"),
        F.when(ok & (F.col("fps") > 0), F.col("frames") / F.col("fps")).otherwise(0.0).alias("duration"), F.when(~ok, F.coalesce("error", F.lit("cannot open video"))).alias("error"),
    )


def file_identity(files: DataFrame) -> DataFrame:
    """Path, size and whole milliseconds of the time; nulls for a missing file."""
    return files.select("path", F.col("size_bytes").alias("size"), F.floor(F.col("mtime_ns") / 1000000).cast("long").alias("mtime_ms"))
