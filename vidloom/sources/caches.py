"""Feature caches, indexes and the store of finished pairs, as partitioned Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import tasks

META = ("path", "size", "mtime_ms", "skip_threshold", "max_gap_sec", "frame_step", "input_size", "embedding_model", "schema_version")


def write_features(frames: DataFrame, path: str, key: Column) -> None:
    """Appends frames to the cache under their profile key, which is a partition and so prunes reads.

    The committer publishes files only when all of them are written.
    """
    frames.withColumn("profile_key", key).write.mode("append").partitionBy("profile_key").parquet(path)


def read_features(spark: SparkSession, path: str, profile_key: str | None = None) -> DataFrame:
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    return df if profile_key is None else df.where(F.col("profile_key") == profile_key)


def fresh_features(cached: DataFrame, expected: DataFrame, by: str = "path", tolerance: float = 1e-6) -> DataFrame:
    """Cached rows whose metadata equals what is expected of their video: texts exactly, numbers within a tolerance."""
    want = expected.select(T.normalize_path(by).alias("__p"), *[F.col(c).alias(f"__{c}") for c in META if c in expected.columns and c != by])
    checks = {c: F.col(c) for c in META if c in expected.columns and c != by}
    ok = tasks.is_fresh(checks, {c: F.col(f"__{c}") for c in checks}, tolerance)
    return cached.withColumn("__p", T.normalize_path(by)).join(want, "__p").where(ok).select(*cached.columns)


def missing_videos(videos: DataFrame, fresh: DataFrame, by: str = "path") -> DataFrame:
    """Videos that have no fresh features and must be embedded."""
    return videos.withColumn("__p", T.normalize_path(by)).join(fresh.select(T.normalize_path(by).alias("__p")).distinct(), "__p", "left_anti").drop("__p")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """Frames of NPZ feature files: ``video_path``, ``frame_pos``, ``frame_index``, ``ts``, ``phash``, ``embedding``.

    Files that can't be read give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)

    def run(batches):  # noqa: ANN001, ANN202
        import io

        import numpy as np
        import pandas as pd

        for x in batches:
            for p, c in zip(x["path"], x["content"]):
                try:
                    z = np.load(io.BytesIO(c), allow_pickle=False)
                    n = len(z["frame_indices"])
                    e = np.asarray(z["embeddings"], dtype=np.float32).reshape(n, -1)
                    video = str(z["video_path"]) if "video_path" in z.files else p
                    yield pd.DataFrame({"video_path": [video] * n, "frame_pos": np.arange(n), "frame_index": z["frame_indices"].astype("int64"), "ts": z["timestamps"].astype("float64"), "phash": [str(h) for h in z["phashes"]], "embedding": list(e)})
                except Exception:
                    continue

    return files.select("path", "content").mapInPandas(run, "video_path string, frame_pos bigint, frame_index bigint, ts double, phash string, embedding array<float>")


def write_index(vectors: DataFrame, path: str) -> None:
    """Video vectors with names, as one table instead of a matrix and a list of names."""
    vectors.select("name", "vector").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_names(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """``position`` and ``name`` of a list of names, one per line; the position is the line number."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("position", "name"))
    return rows if keep_blank else rows.where(F.trim("name") != "")


def append_pairs(results: DataFrame, path: str, signature: str, version: int) -> None:
    """Finished pairs appended to the store under a parameter signature; the latest version of a key counts."""
    results.withColumn("signature", F.lit(signature)).withColumn("version", F.lit(version).cast("long")).write.mode("append").partitionBy("signature").parquet(path)


def read_pairs(spark: SparkSession, path: str, signature: str) -> DataFrame:
    """The stored pairs of a signature, each key's latest version."""
    return tasks.upserted(spark.read.parquet(path).where(F.col("signature") == signature))


def load_states(rows: DataFrame, legacy: DataFrame, signature: str) -> DataFrame:
    """Stored pairs (``pair_key``, ``pair_json``) with rows of earlier per-pair files in front; invalid JSON is skipped."""
    both = rows.where(F.col("signature") == signature).select("pair_key", "pair_json", F.lit(0).alias("version")).unionByName(legacy.select("pair_key", "pair_json", F.lit(1).alias("version")))
    return tasks.upserted(both.where(F.try_parse_json("pair_json").isNotNull() & F.col("pair_json").startswith("{"))).drop("version")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Configuration templates, one JSON object a file; unreadable ones are skipped."""
    return spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED").schema("id string, kind string, name string, config string, updated_at string").json(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task manifests, latest first, with defaults for what is missing; unreadable ones are skipped."""
    schema = "id string, name string, status string, progress double, totalPairs bigint, completedPairs bigint, updated_at string, stages array<struct<id:string,status:string,progress:double,weight:double,elapsedMs:bigint>>, videos array<struct<path:string,size:bigint,mtimeMs:bigint>>"
    t = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "task.json").json(path).where("id is not null")
    return t.withColumn("name", F.coalesce("name", "id")).withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("progress", F.coalesce("progress", F.lit(0.0))).orderBy(F.desc("updated_at"), "id")


def unique_names(incoming: DataFrame, taken: DataFrame, name: str = "name") -> DataFrame:
    """``incoming`` with ``stored_as``: its name, or with ``_1``, ``_2``, ... before the extension where that is taken.

    ``taken`` holds the names that are there. Rows of one name get the smallest free numbers, in order of ``path``; a
    null name stays null. The numbers in use of a name are one row, however many rows want it.
    """
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    rows = incoming.withColumn("__stem", stem).withColumn("__ext", ext)
    wanted = rows.groupBy(name, "__stem", "__ext").agg(F.count(F.lit(1)).alias("__n"))
    there = taken.select(F.col(name).alias("__t")).where("__t is not null").distinct()
    numbered = there.select("__t", F.regexp_extract("__t", r"^(.*)_([0-9]+)(\.[^.]*)?$", 1).alias("s"), F.regexp_extract("__t", r"^(.*)_([0-9]+)(\.[^.]*)?$", 2).try_cast("long").alias("k"), F.regexp_extract("__t", r"^(.*)_([0-9]+)(\.[^.]*)?$", 3).alias("e"))
    plain = wanted.join(there, F.col(name) == F.col("__t")).select(F.col(name).alias("__name"), F.lit(0).cast("long").alias("k"))
    used = plain.unionAll(wanted.join(numbered.where("k > 0"), (F.col("__stem") == F.col("s")) & (F.col("__ext") == F.col("e"))).select(F.col(name).alias("__name"), "k"))
    used = used.groupBy("__name").agg(F.collect_set("k").alias("__used"))
    w = W.partitionBy(name).orderBy("path")
    x = rows.withColumn("__rank", F.row_number().over(w)).join(used, F.col(name) == F.col("__name"), "left")
    taken_numbers = F.coalesce("__used", F.array().cast("array<bigint>"))
    free = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(taken_numbers) + F.col("__rank").cast("long")), taken_numbers)
    k = F.get(free, F.col("__rank") - 1)
    out = F.when(F.col(name).isNull(), None).when(k == 0, F.col(name)).otherwise(F.concat("__stem", F.lit("_"), k.cast("string"), "__ext"))
    return x.select(*incoming.columns, out.alias("stored_as"))


def quarantine_rows(incoming: DataFrame, taken: DataFrame, folder: str, at: str) -> DataFrame:
    """Manifest rows of rejected videos (``path``, ``name``, ``reason``): where each goes, and the reason made short."""
    x = unique_names(incoming, taken)
    return x.select(F.lit(at).alias("timestamp"), F.col("path").alias("original_path"), F.concat(F.lit(folder.rstrip("/") + "/"), "stored_as").alias("destination_path"), T.compact_error("reason").alias("reason"))


def quarantine(rows: DataFrame, path: str) -> None:
    """Appends rejected videos with their reason as JSON lines."""
    rows.write.mode("append").json(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``row``, ``vector`` of NPY files of one vector or a matrix of them; files that can't be read give no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)

    def run(batches):  # noqa: ANN001, ANN202
        import io

        import numpy as np
        import pandas as pd

        for x in batches:
            for p, c in zip(x["path"], x["content"]):
                try:
                    m = np.atleast_2d(np.load(io.BytesIO(c), allow_pickle=False)).astype(np.float32)
                except Exception:
                    continue
                if m.ndim == 2:
                    yield pd.DataFrame({"path": [p] * len(m), "row": np.arange(len(m)), "vector": list(m)})

    return files.select("path", "content").mapInPandas(run, "path string, row bigint, vector array<float>")


def valid_features(cached: DataFrame, legacy: DataFrame, expected: DataFrame, by: str = "path") -> DataFrame:
    """Fresh cached rows, and those of earlier caches of videos that have none."""
    fresh = fresh_features(cached, expected, by)
    return fresh.unionByName(missing_videos(fresh_features(legacy, expected, by), fresh, by))


def save_template(spark: SparkSession, path: str, template: DataFrame) -> None:
    """Adds or replaces templates (``id``, ``kind``, ``name``, ``config``, ``updated_at``), one file each, called after their id.

    Templates are settings, a few rows; an id of other characters than letters, digits, ``-`` and ``_`` is an error.
    """
    rows = template.limit(1001).collect()
    bad = [r["id"] for r in rows if not T.SAFE_ID.match(r["id"] or "")]
    if bad or len(rows) > 1000:
        raise ValueError(f"no ids of templates: {bad}" if bad else "more than 1,000 templates")
    for r in rows:
        _put(spark, f"{path.rstrip('/')}/{r['id']}.json", json.dumps(r.asDict(), ensure_ascii=False, default=str))


def delete_template(spark: SparkSession, path: str, template_id: str) -> bool:
    """Removes a template; false if there was none."""
    if not T.SAFE_ID.match(template_id or ""):
        raise ValueError(f"no id of a template: {template_id}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{template_id}.json")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False))


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it, so that no reader sees half of it."""
    jvm = spark.sparkContext._jvm
    p, t = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, path + ".pending"))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(t, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(t, p)
