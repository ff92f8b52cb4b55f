"""Report files: JSON, CSV and HTML in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as St

from ..functions import text as T
from ..operators import report as O

_PAIR = "completed_at string, video_a string, video_b string, video_a_path string, video_b_path string, a_in_b double, b_in_a double, symmetric_similarity double, avg_similarity_a_to_b double, avg_similarity_b_to_a double, relation string, total_frames_a bigint, total_frames_b bigint, duration_a double, duration_b double, raw_similarity_max double, raw_similarity_mean double, raw_similarity_p95 double, raw_similarity_p99 double, matched_segment_count bigint, matches_a_to_b_total bigint, matches_b_to_a_total bigint, match_threshold double"
_SEGMENT = "source_start double, source_end double, target_start double, target_end double, a_start double, a_end double, b_start double, b_end double, duration double, coverage double, avg_similarity double, confidence double, match_count bigint"
_WINDOW = "direction string, source_start double, source_end double, matched_frame_count bigint, matched_frame_ratio double, avg_similarity double, best_target_start double, best_target_end double"
_MATCH = "source_video string, target_video string, source_frame_index bigint, target_frame_index bigint, source_timestamp double, target_timestamp double, similarity double"


def _struct(ddl: str) -> St.StructType:
    return St.StructType.fromDDL(ddl)


def pair_schema() -> St.StructType:
    s = _struct(_PAIR)
    for name, ddl in (("segments", _SEGMENT), ("matched_segments", _SEGMENT), ("windows", _WINDOW), ("windows_a_to_b", _WINDOW), ("windows_b_to_a", _WINDOW), ("matches_a_to_b", _MATCH), ("matches_b_to_a", _MATCH)):
        s = s.add(name, St.ArrayType(_struct(ddl)))
    return s


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of JSON reports, with ``pair_id`` in order of the report; a report of one pair without a list counts as one."""
    schema = pair_schema()
    whole = St.StructType([*schema.fields, St.StructField("timestamp", St.StringType()), St.StructField("num_pairs", St.LongType()), St.StructField("video_pairs", St.ArrayType(schema))])
    doc = spark.read.schema(whole).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    single = F.array(F.struct(*[F.col(f.name) for f in schema.fields]))
    pairs = F.when(F.col("video_pairs").isNotNull(), F.col("video_pairs")).when(F.col("video_a").isNotNull(), single)
    out = doc.select("timestamp", F.posexplode(pairs).alias("pair_id", "p")).select("pair_id", "timestamp", "p.*")
    return out.withColumn("completed_at", F.coalesce(F.nullif(F.trim("completed_at"), F.lit("")), "timestamp")).drop("timestamp")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of CSV reports; numbers are cast when read by the normaliser, short rows are padded with nulls."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def read_report(spark: SparkSession, json_path: str | None = None, csv_path: str | None = None) -> DataFrame:
    """The JSON report if it can be read, else the CSV one beside it."""
    errors = []
    for path, reader in ((json_path, read_json), (csv_path, read_csv)):
        if path:
            try:
                df = reader(spark, path)
                if df.head(1) or reader is read_csv:
                    return df
                errors.append(f"{path}: no pairs")
            except Exception as e:
                errors.append(f"{path}: {str(e).splitlines()[0]}")
    raise ValueError("; ".join(errors) or "no report given")


def pair_segments(pairs: DataFrame) -> DataFrame:
    """Segments of report pairs under either name, with the names of earlier reports read as A and B sides."""
    one = F.coalesce("matched_segments", "segments")
    s = pairs.select("pair_id", F.explode(one).alias("s")).select("pair_id", "s.*")
    return s.select("pair_id", F.coalesce("a_start", "source_start").alias("a_start"), F.coalesce("a_end", "source_end").alias("a_end"), F.coalesce("b_start", "target_start").alias("b_start"), F.coalesce("b_end", "target_end").alias("b_end"), "coverage", "avg_similarity", "confidence", "match_count")


def pair_windows(pairs: DataFrame) -> DataFrame:
    """Windows of all lists of a pair with their direction, each once."""
    part = lambda c, d: pairs.select("pair_id", F.explode(c).alias("w")).select("pair_id", F.coalesce("w.direction", F.lit(d)).alias("direction"), *[F.col(f"w.{n}") for n in _struct(_WINDOW).names if n != "direction"])
    return O.dedupe_windows(part("windows_a_to_b", "A_to_B").unionByName(part("windows_b_to_a", "B_to_A")).unionByName(part("windows", "combined")))


def pair_matches(pairs: DataFrame) -> DataFrame:
    part = lambda c, d: pairs.select("pair_id", F.lit(d).alias("direction"), F.posexplode(c).alias("match_id", "m")).select("pair_id", "direction", "match_id", "m.*")
    return part("matches_a_to_b", "A_to_B").unionByName(part("matches_b_to_a", "B_to_A"))


def write_json(rows: DataFrame, path: str, timestamp: str, warnings: list[str] | None = None) -> None:
    """Report rows as JSON lines, one pair a line, with a header row in ``_meta`` beside them.

    A single document would have to pass one task; pairs are written by all of them, and the reader takes both forms.
    """
    rows.withColumn("timestamp", F.lit(timestamp)).write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    spark = rows.sparkSession
    meta = rows.agg(F.count(F.lit(1)).alias("num_pairs")).withColumn("timestamp", F.lit(timestamp)).withColumn("warnings", F.array(*[F.lit(w) for w in warnings or []]).cast("array<string>"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_meta")
    del spark


def csv_rows(rows: DataFrame, with_paths: bool = False) -> DataFrame:
    """The columns of the CSV report, missing ones as nulls."""
    names = [*O.CSV_COLUMNS[:3], *(["video_a_path", "video_b_path"] if with_paths else []), *O.CSV_COLUMNS[3:]]
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names])


def write_csv(rows: DataFrame, path: str, with_paths: bool = False) -> None:
    csv_rows(rows, with_paths).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def html_rows(rows: DataFrame) -> DataFrame:
    """``rank``-able HTML table rows, best first, made by the executors."""
    cell = lambda c: F.concat(F.lit("<td>"), T.html_escape(c), F.lit("</td>"))
    from ..functions.relation import format_percent, relation_label

    line = F.concat(F.lit("<tr>"), cell("video_a"), cell("video_b"), cell(format_percent("a_in_b")), cell(format_percent("b_in_a")), cell(format_percent("symmetric_similarity")), cell(relation_label("relation")), F.lit("</tr>"))
    return rows.select(F.coalesce("symmetric_similarity", F.lit(-1.0)).alias("s"), "video_a", "video_b", line.alias("html")).orderBy(F.desc("s"), "video_a", "video_b").select("html")


def write_html(rows: DataFrame, path: str, title: str = "Video similarity report") -> None:
    """An HTML report as text parts in order: head, one row per pair sorted by similarity, tail."""
    spark = rows.sparkSession
    c = O.relation_counters(rows).first()
    head = f"<html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><p>near {c['near']}, clip {c['clip']}, partial {c['partial']}, different {c['different']}</p><table>"
    wrap = lambda t: spark.createDataFrame([(t,)], "html string")
    wrap(head).unionAll(html_rows(rows)).unionAll(wrap("</table></body></html>")).write.mode("overwrite").text(path)


def duplicate_csv(pairs: DataFrame) -> DataFrame:
    """One text column: rows of the duplicate report with its quoting rule."""
    return pairs.select(F.concat_ws(",", *[T.csv_cell(c) for c in pairs.columns]).alias("line"))


def search_results(found: DataFrame, query: str) -> DataFrame:
    """Search results with a rank from 1 and scores of four decimals; ``found`` has ``name`` and ``similarity``."""
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy(F.lit(query)).orderBy(F.desc("similarity"), "name"))
    return found.select(rank.alias("rank"), "name", "similarity", F.format_string("%d. %s (score: %.4f)", rank, F.col("name"), F.col("similarity")).alias("text"))
