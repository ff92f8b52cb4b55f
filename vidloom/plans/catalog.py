"""The registry of queries: name to callable. The SQL that gives the same rows is in ``oracle``.

Every query reads its tables whole. The domain tables stand for what a scan, an
analysis or a report would give; the generic tables stand in where a domain table
lacks the columns (orders as clips and tasks, events as logs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relation as R
from ..functions import text as T
from ..functions import vectors as V
from ..functions.identity import video_identity
from ..operators import candidates, duplicates, logs, offsets, periods, report, running, sampling, scan, similarity, tasks, timeline
from ..session import Scratch
from ..sources import files, reports, subtitles
from . import analyze, oracle, presets

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def query(f: Query) -> Query:
    _registered[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x, 6).alias(name or c)


# Periods and gaps ------------------------------------------------------------------------------


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.track_periods(read(spark, d, "report_segments"), read(spark, d, "report_windows"))


# Similarity ------------------------------------------------------------------------------------


def _label_sims(spark: SparkSession, d: str, k: int) -> DataFrame:
    frames = analyze.label_frames(read(spark, d, "embeddings"))
    return similarity.pair_similarities(similarity.frame_blocks(frames), similarity.all_pairs(frames), k)


def _containment(frames: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    sims = scratch.table(similarity.top_k_join(similarity.frame_blocks(frames), pairs, 10, 0.65), "matches")
    out = analyze.containment(analyze.as_matches(sims, frames, 0.65), pairs, frames)
    return out.select("a", "b", r6("a_in_b"), r6("b_in_a"), r6("symmetric_similarity"), "total_frames_a", "total_frames_b", "duration_a", "duration_b", "relation")


@query
def containment_relation(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: candidate pairs of videos compared, with coverage of both sides and relation."""
    frames, scratch = analyze.clip_frames(read(spark, d, "embeddings")), Scratch(spark, "flagship")
    return _containment(frames, candidates.candidate_pairs(frames, 3, 0.65, scratch=scratch), scratch)


@query
def containment_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same for every pair of videos, as with a candidate limit of 0."""
    frames = analyze.clip_frames(read(spark, d, "embeddings"))
    return _containment(frames, similarity.all_pairs(frames), Scratch(spark, "flagship"))


def _analysis(spark: SparkSession, d: str) -> analyze.Analysis:
    """The whole pipeline with the batch settings and the three best candidates of each video; clips say how long they are."""
    frames = analyze.clip_frames(read(spark, d, "embeddings"))
    said = F.when(F.col("video_id").startswith("n"), F.lit(40.0)).when(F.col("video_id").startswith("c"), F.lit(-1.0))
    return analyze.analyze(frames.withColumn("duration_sec", said), presets.Preset(candidate_limit=3))


@query
def analysis_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = _analysis(spark, d).pairs
    numbers = ("a_in_b", "b_in_a", "symmetric_similarity", "avg_similarity_a_to_b", "avg_similarity_b_to_a")
    return out.select("a", "b", *[r6(c) for c in numbers], "total_frames_a", "total_frames_b", "duration_a", "duration_b", "relation")


@query
def analysis_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _analysis(spark, d).segments
    return s.select("a", "b", *[r6(c) for c in ("source_start", "source_end", "target_start", "target_end")], F.round("confidence", 6).alias("confidence"), "match_count")


@query
def analysis_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _analysis(spark, d).windows
    return w.select("a", "b", "direction", "window", r6("source_start"), r6("source_end"), "matched_frame_count", r6("matched_frame_ratio"), F.round("avg_similarity", 6).alias("avg_similarity"), r6("best_target_start"), r6("best_target_end"))


@query
def topk_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    return _label_sims(spark, d, 3).where("sim >= 0.25").select("a", "b", "direction", "src", "tgt", "sim", "rank")


@query
def bidirectional_matches(spark: SparkSession, d: str) -> DataFrame:
    m = _label_sims(spark, d, 3).where("sim >= 0.25")
    return m.groupBy("a", "b").pivot("direction", ["A_to_B", "B_to_A"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"A_to_B": "matches_a_to_b", "B_to_A": "matches_b_to_a"})


@query
def best_match_stats(spark: SparkSession, d: str) -> DataFrame:
    s = similarity.best_match_stats(_label_sims(spark, d, 1), 0.3)
    return s.select("a", "b", "direction", "matched_frames", r6("avg_similarity"))


def _raw(s: DataFrame) -> DataFrame:
    """Six digits; a mean that lies on half a digit is lifted off it, as the order of adding would decide."""
    return s.select("a", "b", r6("raw_max"), r6(F.col("raw_mean") + 1e-9, "raw_mean"), r6("raw_p95"), r6("raw_p99"))


@query
def raw_similarity_stats(spark: SparkSession, d: str) -> DataFrame:
    return _raw(similarity.raw_stats(_label_sims(spark, d, 1)))


@query
def raw_stats_early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Raw statistics where pairs that show nothing from their smaller side aren't compared from the other one."""
    frames = analyze.label_frames(read(spark, d, "embeddings"))
    sims = similarity.early_stopped_similarities(similarity.frame_blocks(frames), similarity.all_pairs(frames), 1, oracle.EARLY_THRESHOLD)
    return _raw(similarity.raw_stats(sims))


@query
def video_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors most similar to each one whose id is divisible by 100, itself included."""
    e = read(spark, d, "embeddings")
    return similarity.search_top_k(e, e.where("vec_id % 100 = 0"), 10)


@query
def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    s = similarity.embedding_stats(read(spark, d, "embeddings"))
    return s.select("num_embeddings", "embedding_dim", *[r6(c) for c in ("mean_norm", "std_norm", "min_norm", "max_norm")])


@query
def video_diversity(spark: SparkSession, d: str) -> DataFrame:
    s = similarity.diversity(analyze.label_frames(read(spark, d, "embeddings")))
    return s.select("video_id", "n", r6("mean_similarity"))


@query
def video_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of every label as one row per component."""
    v = similarity.mean_vector(analyze.label_frames(read(spark, d, "embeddings")), ["video_id"])
    return v.select("video_id", F.posexplode("mean_vector").alias("dim", "x")).select("video_id", "dim", r6("x"))


@query
def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.all_pairs(analyze.clip_frames(read(spark, d, "embeddings")))


@query
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return candidates.candidate_pairs(analyze.clip_frames(read(spark, d, "embeddings")), 3, 0.65)


@query
def candidate_pairs_default(spark: SparkSession, d: str) -> DataFrame:
    """With the limit of 20 that is the default."""
    return candidates.candidate_pairs(analyze.clip_frames(read(spark, d, "embeddings")), 20, 0.65)


@query
def candidate_pairs_forest(spark: SparkSession, d: str) -> DataFrame:
    """The approximate form."""
    return candidates.candidate_pairs(analyze.clip_frames(read(spark, d, "embeddings")), 3, 0.65, method="forest")


@query
def representative_positions(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "frames").groupBy(video_identity("video_path").alias("video_id")).agg(F.countDistinct("frame_id").alias("n")).where("video_id is not null")
    return candidates.even_positions(n, 16)


@query
def diverse_frames(spark: SparkSession, d: str) -> DataFrame:
    return sampling.diverse_sample(analyze.label_frames(read(spark, d, "embeddings")))


@query
def phash_steps(spark: SparkSession, d: str) -> DataFrame:
    """Hash similarity of every frame to the frame before it."""
    f = read(spark, d, "frames").select("frame_id", video_identity("video_path").alias("v"), "frame_index", V.hash_long("phash").alias("h"))
    f = f.groupBy("frame_id").agg(F.max("v").alias("v"), F.max("frame_index").alias("frame_index"), F.max("h").alias("h")).where("v is not null and h is not null")
    f = running.running(f, ["v"], ["frame_index", "frame_id"], before={"before": F.col("h")})
    return f.where("before is not null").select("frame_id", V.hash_similarity("h", "before").alias("similarity"))


# Offsets, segments, windows --------------------------------------------------------------------


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Frame matches, each once, with the frame count and duration of their source."""
    sim = F.col("similarity")
    m = read(spark, d, "frame_matches").where(F.col("source_frame_index").isNotNull() & sim.isNotNull() & ~F.isnan(sim))
    m = m.groupBy("match_id", "pair_id", "direction", F.col("source_frame_index").alias("src"), R.normalized_ratio(sim).alias("sim"))
    m = m.agg(F.max("target_frame_index").alias("tgt"), F.max("source_timestamp").alias("src_ts"), F.max("target_timestamp").alias("tgt_ts"))
    p = read(spark, d, "report_pairs").groupBy("pair_id").agg(F.max("total_frames_a").alias("fa"), F.max("total_frames_b").alias("fb"))
    return m.join(p, "pair_id").withColumn("total", F.when(F.col("direction") == "A_to_B", F.col("fa")).otherwise(F.col("fb"))).drop("fa", "fb")


@query
def temporal_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = offsets.temporal_coverage(_matches(spark, d), ["pair_id", "direction"], "total")
    return c.select("pair_id", "direction", r6("coverage"))


@query
def offset_clusters(spark: SparkSession, d: str) -> DataFrame:
    return offsets.offset_clusters(_matches(spark, d), ["pair_id", "direction"], 3.0).select("match_id", "cluster")


@query
def matched_segments(spark: SparkSession, d: str) -> DataFrame:
    s = offsets.segments(_matches(spark, d), ["pair_id", "direction"], dedupe=False)
    return s.select("pair_id", "direction", *[r6(c) for c in ("source_start", "source_end", "target_start", "target_end", "duration", "coverage")], F.round("avg_similarity", 9).alias("avg_similarity"), F.round("confidence", 9).alias("confidence"), "match_count")


@query
def segments_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Segments over the matches of both directions of a pair, mirror images once."""
    s = offsets.segments(_matches(spark, d), ["pair_id"])
    return s.select("pair_id", *[r6(c) for c in ("source_start", "source_end", "target_start", "target_end")], F.round("confidence", 9).alias("confidence"), "match_count")


@query
def window_similarity(spark: SparkSession, d: str) -> DataFrame:
    w = offsets.fixed_windows(_matches(spark, d).where("tgt_ts is not null"), ["pair_id", "direction"], 30.0)
    return w.select("pair_id", "direction", "window", r6("source_start"), r6("source_end"), "matched_frame_count", r6("matched_frame_ratio"), F.round("avg_similarity", 9).alias("avg_similarity"), r6("best_target_start"), r6("best_target_end"))


# Sampling --------------------------------------------------------------------------------------


def _hashed_frames(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "frames").select(video_identity("video_path").alias("video"), "frame_index", V.hash_long("phash").alias("bits"))
    return f.where("video is not null and frame_index is not null and bits is not null").distinct().withColumn("max_gap", F.lit(40))


@query
def dynamic_sampling(spark: SparkSession, d: str) -> DataFrame:
    return sampling.dynamic_sample(_hashed_frames(spark, d), "video", "frame_index", "bits", "max_gap", 0.60).select("video", "frame_index", "bits")


@query
def stream_sampler(spark: SparkSession, d: str) -> DataFrame:
    """The same frames, kept by a stateful stream over the file."""
    from ..streaming.incremental import run_available
    from ..streaming.stateful import PROVIDER, sample_stream

    scratch = Scratch(spark, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    table = scratch.table(_hashed_frames(spark, d), "frames")
    source = spark.readStream.schema(table.schema).parquet(table._vidloom_path)
    out = f"{scratch.root}/kept"
    run_available(sample_stream(source, "video", "frame_index", "bits", "max_gap", 0.60), lambda df, n: df.write.mode("append").parquet(out), f"{scratch.root}/checkpoint")
    return spark.read.parquet(out).select("video", "frame_index", "bits")


@query
def frame_step_filter(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: every sixth frame by index."""
    return sampling.step_filter(read(spark, d, "frames"), 6).select("frame_id", "frame_index").distinct()


# Duplicates ------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"), "text")


@query
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_groups(_files(spark, d), "doc_id", "size", "text").select("members", "first", "redundant_bytes")


@query
def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_pairs(_files(spark, d), "doc_id", "size", "text").select("a", "b", "relation", "symmetric_similarity")


@query
def redundant_copies(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.redundant_copies(_files(spark, d), "doc_id", "size", "text").select("doc_id")


# Scans -----------------------------------------------------------------------------------------


def _videos(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "videos")
    return v.select("scan_id", F.col("video_path").alias("path"), F.col("video_name").alias("name"), "extension", "size_bytes", "size_mb", "modified_at_ms").distinct()


def _durations(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "report_pairs").select(F.explode(F.array(F.struct(F.col("video_a_path").alias("path"), F.col("duration_a").alias("x")), F.struct(F.col("video_b_path").alias("path"), F.col("duration_b").alias("x")))).alias("s"))
    x = F.col("s.x")
    good = F.when(x.isNotNull() & ~F.isnan(x) & (x > 0), x)
    p = p.select(T.normalize_path("s.path").alias("path"), good.alias("duration")).where("path is not null and path <> '-'")
    return p.groupBy("path").agg(F.max("duration").alias("duration")).withColumn("readable", F.col("duration").isNotNull())


@query
def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    f = scan.ScanFilter(frozenset({"size", "name", "extension"}), min_size=20, max_size=600, size_unit="mb", name_includes="bridge, tram；lantern", extensions=".mp4 mkv,MOV")
    return scan.filter_scan(_videos(spark, d), f).select("scan_id", "name", "size_bytes")


@query
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    f = scan.ScanFilter(frozenset({"duration"}), min_duration=2, max_duration=4, duration_unit="minute")
    return scan.filter_scan(_videos(spark, d), f, _durations(spark, d)).select("scan_id")


@query
def metadata_join(spark: SparkSession, d: str) -> DataFrame:
    return scan.join_metadata(_videos(spark, d), _durations(spark, d)).select("scan_id", F.round("duration", 3).alias("duration"), F.coalesce("readable", F.lit(False)).alias("readable"))


@query
def scan_sort(spark: SparkSession, d: str) -> DataFrame:
    """Files by size with their place; scans of one file that tie are told apart by their id."""
    v = _videos(spark, d).where("size_bytes is not null")
    return running.places(v, [*scan.scan_order("size", descending=True), F.col("scan_id").asc()]).select("scan_id", "size_bytes", "place")


@query
def scan_sort_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Files by duration with their place, those without one last."""
    v = scan.join_metadata(_videos(spark, d), _durations(spark, d))
    return running.places(v, [*scan.scan_order("duration"), F.col("scan_id").asc()]).select("scan_id", "place")


@query
def explicit_scan(spark: SparkSession, d: str) -> DataFrame:
    """The scanned files that reports name as their A side, but for one folder."""
    found = scan.explicit_list(read(spark, d, "report_pairs").select(F.col("video_a_path").alias("path")), _videos(spark, d), "/srv/video/archive")
    return found.select(T.normalize_path("path").alias("path"))


@query
def inputs_changed(spark: SparkSession, d: str) -> DataFrame:
    """What the last scan of every file says against the first one."""
    v = _videos(spark, d).where("path is not null")
    fact = F.struct("path", F.col("size_bytes").alias("size"), F.col("modified_at_ms").alias("mtime_ms"))
    ends = v.groupBy(T.normalize_path("path").alias("p")).agg(F.min_by(fact, "scan_id").alias("old"), F.max_by(fact, "scan_id").alias("new"))
    return tasks.inputs_changed(ends.select("old.*"), ends.select("new.*"))


@query
def fresh_scans(spark: SparkSession, d: str) -> DataFrame:
    """Files whose first scan still says what the last one does."""
    v = _videos(spark, d).where("path is not null")
    fact = F.struct("size_mb", "extension", "modified_at_ms")
    ends = v.groupBy(T.normalize_path("path").alias("path")).agg(F.min_by(fact, "scan_id").alias("old"), F.max_by(fact, "scan_id").alias("new"))
    names = ("size_mb", "extension", "modified_at_ms")
    return ends.select("path", tasks.is_fresh({n: F.col(f"old.{n}") for n in names}, {n: F.col(f"new.{n}") for n in names}).alias("fresh"))


@query
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    s = scan.scan_summary(_videos(spark, d).where("size_mb is not null and not isnan(size_mb)"))
    return s.select("videos", F.round("total_mb", 2).alias("total_mb"))


@query
def cache_inventory(spark: SparkSession, d: str) -> DataFrame:
    v = _videos(spark, d).select(F.lower("extension").alias("category"), F.substring_index(T.normalize_path("path"), "/", 2).alias("name"), "size_bytes")
    return files.inventory(v).select("category", "name", "size_bytes", "entries", F.col("level").cast("int").alias("level"))


@query
def report_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Orders as report files: a customer is a stem, the status the format."""
    ext = F.when(F.col("o_orderstatus") == "F", "json").when(F.col("o_orderstatus") == "O", "csv").otherwise("html")
    o = read(spark, d, "orders").select(F.concat(F.lit("/reports/r"), F.col("o_custkey").cast("string"), F.lit("."), ext).alias("path"), ext.alias("extension"), F.floor("o_totalprice").alias("size_bytes"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("modified_at_ms"))
    return files.report_catalogue(o).select("report_key", "size_bytes", "modified_ms", F.array_join("formats", "+").alias("formats"), "path")


# Logs ------------------------------------------------------------------------------------------


def _log_lines(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select(F.col("doc_id").alias("video"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return t


@query
def stream_validation(spark: SparkSession, d: str) -> DataFrame:
    """Events as the error lines of each user's stream; large purchases as fatal ones."""
    fatal = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    lines = _event_lines(spark, d).withColumn("line", F.when(fatal, "moov atom not found").otherwise(F.col("line")))
    v = logs.validate_streams(lines, "lenient", severe_limit=20, missing_limit=12, video="stream")
    return v.select("video", "severe", "missing", "verdict")


@query
def log_filter(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of every document are hidden or important."""
    x = _log_lines(spark, d)
    return x.groupBy("video").agg(F.count_if(logs.is_hidden("line")).alias("hidden"), F.count_if(logs.is_important("line")).alias("important"), F.count_if(logs.is_decode_failure("line")).alias("decode_failures"))


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    line = F.when(F.col("event_type") == "error", "[h264 @ 1] Invalid NAL unit size (10 > 2).").when(F.col("event_type") == "view", "missing picture in access unit with size 5").otherwise("[h264 @ 1] other")
    marker = F.when((F.col("event_type") == "signup") & (F.col("value") < 1), F.col("event_id").cast("string"))
    return e.select(F.col("user_id").alias("stream"), F.struct("ts", "event_id").alias("line_no"), "event_id", "event_type", marker.alias("marker"), line.alias("line"), "ts", "value")


@query
def log_warning_summaries(spark: SparkSession, d: str) -> DataFrame:
    x = logs.with_context(_event_lines(spark, d), "stream", "line_no", F.col("marker")).where("marker is null")
    s = logs.warning_summaries(x)
    return s.select("stream", "episode", "context", "kind", "invalid_nal", "missing_picture", "other", "total")


@query
def monotone_progress(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "ts", F.col("value").alias("progress"))
    return logs.monotone_progress(e, "user_id", ["ts", "event_id"], "progress").select("event_id", "shown")


@query
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the last 20 events of every user."""
    return logs.tail(read(spark, d, "events"), "user_id", ["ts", "event_id"], 20).select("event_id")


@query
def line_router(spark: SparkSession, d: str) -> DataFrame:
    return _log_lines(spark, d).groupBy(logs.route("line").alias("route")).agg(F.count(F.lit(1)).alias("lines"))


# Tasks -----------------------------------------------------------------------------------------


@query
def task_stages(spark: SparkSession, d: str) -> DataFrame:
    """Each user's task: its progress, the next stage, and what must be completed before pairs are compared."""
    e = read(spark, d, "events")
    names = F.array(*[F.lit(s) for s in ("scan", "cache", "features", "candidate")])
    status = F.when(F.col("event_type").isin("purchase", "click"), "completed").when(F.col("event_type") == "view", "running").otherwise("failed")
    at = F.struct("ts", "event_id")
    s = e.groupBy(F.col("user_id").alias("task"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("id"))
    s = s.agg(F.max_by(status, at).alias("status"), F.max_by("value", at).alias("progress")).withColumn("weight", F.lit(None).cast("double"))
    m = tasks.merge_stages(s)
    out = tasks.weighted_progress(m, ["task"]).join(tasks.next_stage(m), "task").join(tasks.blocking_stages(m, "compare"), "task")
    return out.select("task", "progress", "next_stage", F.array_join("blocking", ",").alias("blocking"))


@query
def elapsed_stages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stages of each customer's task: open ones run since their date."""
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    s = o.select("o_custkey", status.alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started_ms"), F.floor("o_totalprice").alias("elapsed_ms"), F.lit(893_000_000_000).alias("now_ms"))
    return tasks.elapsed(s, ["o_custkey"])


@query
def merged_reports(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reports: the latest one of each customer."""
    o = read(spark, d, "orders")
    path = lambda ext, *status: F.when(F.col("o_orderstatus").isin(*status), F.concat(F.lit("/r/"), F.col("o_orderkey").cast("string"), F.lit(ext)))
    r = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("report_key"), path(".json", "F").alias("json_path"), path(".csv", "F", "O").alias("csv_path"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("modified_ms"))
    return report.merge_reports(r)


@query
def weighted_progress(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("o_orderstatus") == "F", 100.0).when(F.col("o_orderstatus") == "O", 0.0).otherwise(55.5)
    return tasks.weighted_progress(read(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("weight"), p.alias("progress")), ["o_custkey"])


@query
def stage_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events as stage changes of each user's task."""
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "paused").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    e = read(spark, d, "events").select(F.col("user_id").alias("task"), F.lit("compare").alias("stage"), F.struct("ts", "event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), status.alias("status"), F.col("value").alias("progress"))
    return tasks.replay_stages(e)


@query
def smallest_unused(spark: SparkSession, d: str) -> DataFrame:
    return tasks.smallest_unused(read(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 7 + 1).alias("n")), ["o_custkey"])


@query
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of configuration 3 that no other configuration has finished."""
    p = read(spark, d, "report_pairs").select(T.normalize_path("video_a_path").alias("x"), T.normalize_path("video_b_path").alias("y"), F.col("config_id").cast("string").alias("signature"))
    p = p.withColumn("pair_key", F.concat_ws("||", F.least("x", "y"), F.greatest("x", "y"))).where("x is not null and y is not null")
    store = p.where("signature <> '3'").withColumn("signature", F.lit("other"))
    return tasks.pending_pairs(p.where("signature = '3'").select("pair_key").distinct(), store, "other")


@query
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every pair of videos."""
    p = read(spark, d, "report_pairs").where("completed_at is not null").select(T.normalize_path("video_a_path").alias("x"), T.normalize_path("video_b_path").alias("y"), "pair_id", F.struct("completed_at", "pair_id").alias("version"))
    p = p.where("x is not null and y is not null").withColumn("pair_key", F.concat_ws("||", F.least("x", "y"), F.greatest("x", "y")))
    return tasks.upserted(p).select("pair_key", "pair_id")


# Reports ---------------------------------------------------------------------------------------


def _report(spark: SparkSession, d: str) -> DataFrame:
    return report.normalize_pairs(read(spark, d, "report_pairs").dropDuplicates(["pair_id"]))


@query
def report_normalise(spark: SparkSession, d: str) -> DataFrame:
    n = _report(spark, d)
    return n.select("pair_id", "pair_key", "video_a", "video_b", r6("a_in_b"), r6("b_in_a"), r6("symmetric_similarity"), "relation", "total_frames_a", "matched_segment_count")


@query
def report_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return report.dedupe_pairs(_report(spark, d)).select("pair_key", "pair_id", "completeness")


@query
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summarize_pairs(_report(spark, d))


@query
def relation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.relation_histogram(_report(spark, d))


@query
def relation_counters(spark: SparkSession, d: str) -> DataFrame:
    return report.relation_counters(_report(spark, d))


@query
def report_filter(spark: SparkSession, d: str) -> DataFrame:
    return report.filter_pairs(_report(spark, d), "clip", "TRAM", 0.3).select("pair_id", "relation", r6("symmetric_similarity"))


@query
def report_classes(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs each class of the filter keeps."""
    n = _report(spark, d)
    kinds = ("all", "near", "partial", "clip", "unknown", "different")
    counts = n.agg(*[F.count_if(R.relation_matches("relation", k)).alias(k) for k in kinds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("pairs")) for k in kinds])).alias("x")).select("x.*")


@query
def report_sorts(spark: SparkSession, d: str) -> DataFrame:
    """The place of every pair under every sort key, best first."""
    n = Scratch(spark, "sorts").table(_report(spark, d), "pairs")
    parts = [running.places(n, report.sort_order(k)).select(F.lit(k).alias("sort_key"), "pair_id", "place") for k in report.SORT_KEYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def report_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 25 pairs by similarity."""
    return report.page(report.sort_pairs(_report(spark, d)), 3, 25).select("pair_id", r6("symmetric_similarity"))


@query
def video_entries(spark: SparkSession, d: str) -> DataFrame:
    return report.video_entries(_report(spark, d)).select("pair_key", "side", "video", "path")


@query
def delete_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The report without the pairs that were compared as configuration 8 saw them."""
    p = read(spark, d, "report_pairs")
    return report.delete_pairs(_report(spark, d), p.where("config_id = 8 and video_a_path is not null and video_b_path is not null")).select("pair_id")


@query
def match_orientation(spark: SparkSession, d: str) -> DataFrame:
    m = report.normalize_matches(read(spark, d, "frame_matches").where("similarity is not null and not isnan(similarity)"), 0.6)
    return m.select("match_id", "direction", "frame_a", "frame_b", "ts_a", r6("similarity")).distinct()


@query
def top240_matches(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the matches that a report keeps of each pair and direction."""
    m = read(spark, d, "frame_matches").where("similarity is not null and not isnan(similarity)").select("match_id", "pair_id", "direction", R.normalized_ratio("similarity").alias("similarity")).distinct()
    return report.top_matches(m).select("match_id", "rank", "total")


@query
def dedupe_windows(spark: SparkSession, d: str) -> DataFrame:
    w = report.dedupe_windows(read(spark, d, "report_windows").where("source_start is not null and source_end is not null and not isnan(source_start) and not isnan(source_end)"))
    return w.groupBy("direction").agg(F.count(F.lit(1)).alias("windows"))


@query
def html_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.html_rows(_report(spark, d))


# Timeline --------------------------------------------------------------------------------------


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Orders as clips: the customer is the composition, days are seconds."""
    o = read(spark, d, "orders")
    start = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("double")
    return o.select(F.col("o_custkey").alias("composition"), (F.col("o_orderkey") % 3).alias("track"), F.col("o_orderkey").alias("clip"), start.alias("start"), (start + 1 + F.floor(F.col("o_totalprice") / 1000)).alias("end"), "o_orderpriority")


@query
def timeline_intervals(spark: SparkSession, d: str) -> DataFrame:
    t = timeline.elementary_intervals(_clips(spark, d), ["composition"], bucket=200.0)
    return t.select("composition", "start", "end", F.array_join(F.transform("active", lambda x: x.cast("string")), ",").alias("active"))


@query
def total_duration(spark: SparkSession, d: str) -> DataFrame:
    return timeline.total_duration(_clips(spark, d))


@query
def active_at(spark: SparkSession, d: str) -> DataFrame:
    return timeline.active_at(_clips(spark, d), 2500.5).select("track", "clip", "start")


@query
def points_in_clips(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a point, and the clips of its track and customer that cover it."""
    c = _clips(spark, d).withColumn("track", F.col("composition") * 3 + F.col("track"))
    p = c.select("track", (F.col("start") + 0.5).alias("at"), F.col("clip").alias("point"))
    return timeline.points_in_intervals(p, c, 100.0).select("point", "clip")


@query
def sequential_track_cursor(spark: SparkSession, d: str) -> DataFrame:
    c = _clips(spark, d)
    wanted = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("start"))
    return timeline.sequential_starts(c.select(F.col("composition").alias("track"), "clip", wanted.alias("requested"), (F.col("end") - F.col("start")).alias("duration")))


@query
def track_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = _clips(spark, d).withColumn("track", F.col("composition"))
    return timeline.neighbours_on_track(c).select("clip", "previous", "next")


@query
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return timeline.grid_cells(_clips(spark, d).select("composition", "clip"), 1920, 1080, "composition", "clip").select("clip", "x", "y", "cell_width", "cell_height")


# Scalars ---------------------------------------------------------------------------------------


@query
def ratio_normalise(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "report_pairs").dropDuplicates(["pair_id"])
    return p.select("pair_id", R.normalized_ratio("a_in_b").alias("a_in_b"), R.format_percent("b_in_a").alias("b_in_a"), R.format_score("symmetric_similarity").alias("score"))


@query
def path_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "videos").where("video_path is not null").select("scan_id", "video_path").distinct()
    return v.select("scan_id", T.normalize_path("video_path").alias("path"), T.basename(T.normalize_path("video_path")).alias("base"))


@query
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Names and paths of scans in the forms that caches, reports and filter graphs need."""
    v = read(spark, d, "videos").where("video_name is not null and video_path is not null").select("scan_id", "video_name", "video_path", "modified_at_ms").distinct()
    n = F.col("video_name")
    return v.select(
        "scan_id", T.safe_name(n).alias("safe"), T.is_safe_id(T.stem(n)).alias("safe_id"), T.extension("video_path").alias("ext"), T.stem("video_path").alias("stem"), T.sibling(n, "srt").alias("sibling"), T.csv_cell(F.concat(n, F.lit(',"x"'))).alias("csv"),
        T.html_escape(F.concat(n, F.lit("<&'\">"))).alias("html"), T.drawtext_escape(F.concat(n, F.lit("a:b,'5%'"))).alias("drawtext"), T.compact_error(F.concat_ws("  ", n, n, n, n, n, n, n, n)).alias("error"), T.progress_text(F.concat(n, F.lit("|x"))).alias("progress"),
        T.short_hash(n).alias("hash"), T.natural_key(n).alias("natural"), T.time_value(F.col("modified_at_ms").cast("string")).alias("at"), R.relation_tone(F.concat(n, F.lit(" clip"))).alias("tone"), R.first_text(F.lit(" "), n).alias("said"),
    )


@query
def timecode_format(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "frames").groupBy("frame_id").agg(F.max("ts").alias("ts"))
    return f.select("frame_id", T.hhmmss("ts").alias("hhmmss"), F.when(F.col("ts").isNotNull(), T.clock("ts")).alias("clock"))


@query
def size_format(spark: SparkSession, d: str) -> DataFrame:
    return _videos(spark, d).select("scan_id", T.file_size("size_bytes").alias("size")).distinct()


@query
def profile_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "analysis_config").select("config_id", T.profile_key("preset_name", "skip_threshold", "max_gap_sec", "frame_step").alias("profile"))


@query
def progress_parse(spark: SparkSession, d: str) -> DataFrame:
    phase = F.element_at(F.array(*[F.lit(p) for p in ("scan", "index", "compare", "report", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    line = F.concat_ws("|", F.lit("PROGRESS"), phase, F.floor("value").cast("string"), F.lit("500"), F.col("event_type"))
    p = read(spark, d, "events").select("event_id", T.parse_progress(line).alias("p")).where("p is not null")
    return p.select("event_id", "p.stage", "p.progress")


@query
def subtitle_cues(spark: SparkSession, d: str) -> DataFrame:
    c = subtitles.timed_cues(read(spark, d, "documents"))
    return c.select("doc_id", "cue", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@query
def engine_relation(spark: SparkSession, d: str) -> DataFrame:
    n = _report(spark, d).where("a_in_b is not null and b_in_a is not null")
    sizes = ("total_frames_a", "total_frames_b", "duration_a", "duration_b")
    return n.select("pair_id", R.relation_engine("a_in_b", "b_in_a", *sizes).alias("engine"), R.relation_report("a_in_b", "b_in_a", 0.8, *sizes).alias("report"))


def queries() -> dict[str, Query]:
    return dict(_registered)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _registered}
