"""The similarity analysis from frames to labelled pairs, and the views it runs on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.relation import relation_engine
from ..operators import candidates, offsets, similarity
from ..session import Scratch
from .presets import Preset


@dataclass
class Analysis:
    """Results of an analysis, all lazy over two written tables (similarities and matches)."""

    pairs: DataFrame
    matches: DataFrame
    segments: DataFrame
    windows: DataFrame


def as_matches(similarities: DataFrame, frames: DataFrame, threshold: float) -> DataFrame:
    """Matches with times: ``a``, ``b``, ``direction``, ``src``, ``tgt``, ``src_ts``, ``tgt_ts``, ``sim``, ``total``."""
    f = frames.select("video_id", F.col("frame_pos").cast("long").alias("pos"), "ts")
    n = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))
    forward = F.col("direction") == "A_to_B"
    m = similarities.where(F.col("sim") >= threshold).withColumn("sv", F.when(forward, F.col("a")).otherwise(F.col("b"))).withColumn("tv", F.when(forward, F.col("b")).otherwise(F.col("a")))
    m = m.join(f.select(F.col("video_id").alias("sv"), F.col("pos").alias("src"), F.col("ts").alias("src_ts")), ["sv", "src"])
    m = m.join(f.select(F.col("video_id").alias("tv"), F.col("pos").alias("tgt"), F.col("ts").alias("tgt_ts")), ["tv", "tgt"])
    return m.join(n.select(F.col("video_id").alias("sv"), "total"), "sv").select("a", "b", "direction", "src", "tgt", "src_ts", "tgt_ts", "sim", "total")


#: What a frame may say of the length of its video, in order of preference.
DURATION_COLUMNS = ("duration_sec", "source_duration_sec", "retained_duration_sec")


def video_facts(frames: DataFrame) -> DataFrame:
    """``video_id``, ``n`` frames, ``d`` seconds: the first stated duration above 0, else the latest time, else 0."""
    stated = [F.max(F.when((F.col(c).cast("double") > 0) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))) for c in DURATION_COLUMNS if c in frames.columns]
    latest = F.max(F.when(~F.isnan("ts"), F.col("ts")))
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(*stated, latest, F.lit(0.0)).alias("d"))


def containment(matches: DataFrame, pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Coverage of both sides of every pair, frame counts, durations and the relation."""
    cov = offsets.temporal_coverage(matches, ["a", "b", "direction"], "total")
    side = lambda d: F.coalesce(F.max(F.when(F.col("direction") == d, F.col("coverage"))), F.lit(0.0))
    cov = cov.groupBy("a", "b").agg(side("A_to_B").alias("a_in_b"), side("B_to_A").alias("b_in_a"))
    facts = video_facts(frames)
    x = pairs.select("a", "b").distinct().join(cov, ["a", "b"], "left")
    x = x.join(facts.select(F.col("video_id").alias("a"), F.col("n").alias("total_frames_a"), F.col("d").alias("duration_a")), "a")
    x = x.join(facts.select(F.col("video_id").alias("b"), F.col("n").alias("total_frames_b"), F.col("d").alias("duration_b")), "b")
    x = x.withColumn("a_in_b", F.coalesce("a_in_b", F.lit(0.0))).withColumn("b_in_a", F.coalesce("b_in_a", F.lit(0.0)))
    label = relation_engine("a_in_b", "b_in_a", "total_frames_a", "total_frames_b", "duration_a", "duration_b")
    return x.select("a", "b", "a_in_b", "b_in_a", ((F.col("a_in_b") + F.col("b_in_a")) / 2).alias("symmetric_similarity"), "total_frames_a", "total_frames_b", "duration_a", "duration_b", label.alias("relation"))


def analyze(frames: DataFrame, preset: Preset | None = None, pairs: DataFrame | None = None, method: str = "exact") -> Analysis:
    """Candidate pairs, matches in both directions, coverage, relations, segments and windows.

    ``frames``: ``video_id``, ``frame_pos``, ``ts``, ``embedding``, and any of ``DURATION_COLUMNS``. ``pairs`` (``a``, ``b``)
    replaces the candidate stage; ``method`` chooses how candidates are found. With early stop a pair without anything
    alike in the direction of its smaller side isn't computed in the other one.
    """
    p = (preset or Preset()).clamped()
    scratch = Scratch(frames.sparkSession, "analysis")
    frames = frames.where("video_id is not null and frame_pos is not null and size(embedding) > 0")
    if pairs is None:
        pairs = candidates.candidate_pairs(frames, p.candidate_limit, p.match_threshold, method=method, scratch=scratch)
    pairs = scratch.table(pairs, "pairs")
    blocks = scratch.table(similarity.frame_blocks(frames), "blocks")
    if p.early_stop:
        sims = similarity.early_stopped_similarities(blocks, pairs, p.top_k, p.match_threshold, p.early_stop_margin, p.match_threshold, scratch)
    else:
        sims = similarity.pair_similarities(blocks, pairs, p.top_k, least=p.match_threshold, scratch=scratch)
    sims = scratch.table(sims, "similarities")
    scratch.drop(blocks)
    matches = scratch.table(as_matches(sims, frames, p.match_threshold), "matches")
    out = containment(matches, pairs, frames)
    stats = similarity.best_match_stats(sims, p.match_threshold).groupBy("a", "b").pivot("direction", ["A_to_B", "B_to_A"]).agg(F.first("avg_similarity"))
    stats = stats.withColumnsRenamed({"A_to_B": "avg_similarity_a_to_b", "B_to_A": "avg_similarity_b_to_a"}).na.fill(0.0)
    out = out.join(stats, ["a", "b"], "left").join(similarity.raw_stats(sims), ["a", "b"], "left").orderBy(F.desc("symmetric_similarity"), "a", "b")
    keys = ["a", "b"]
    segs = offsets.segments(matches, keys, p.min_segment_duration, p.min_segment_matches, p.offset_tolerance)
    wins = offsets.fixed_windows(matches, [*keys, "direction"], p.window_size)
    return Analysis(out, matches, segs, wins)


def clip_frames(embeddings: DataFrame) -> DataFrame:
    """Overlapping virtual videos that share vectors: windows of 75, clips of 30 and near copies of 72 vectors.

    Every vector of the table is in one to five of them. ``video_id``: window i is ``v`` and i, starting at 30 i; clip j
    is ``c`` and j, from 60 j + 10; copy j is ``n`` and j, from 150 j.
    """
    e = embeddings.select("vec_id", "embedding")
    parts = []
    for letter, step, first, size in (("v", 30, 0, 75), ("c", 60, 10, 30), ("n", 150, 0, 72)):
        back = F.sequence(F.lit(0), F.lit((size - 1) // step))
        k = F.floor((F.col("vec_id") - first) / step)
        x = e.withColumn("k", F.explode(F.transform(back, lambda i: k - i))).where((F.col("k") >= 0) & (F.col("vec_id") - first - F.col("k") * step < size))
        parts.append(x.select(F.concat(F.lit(letter), F.format_string("%06d", F.col("k"))).alias("video_id"), (F.col("vec_id") - first - F.col("k") * step).alias("frame_pos"), "embedding"))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.withColumn("ts", F.col("frame_pos") * 0.5)


def label_frames(embeddings: DataFrame) -> DataFrame:
    """One video per label, its vectors in order of their id, half a second apart."""
    pos = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return embeddings.select(F.col("label").alias("video_id"), "vec_id", pos.cast("long").alias("frame_pos"), "embedding").withColumn("ts", F.col("frame_pos") * 0.5)


def analyze_table(spark: SparkSession, path: str, preset: Preset | None = None) -> Analysis:
    """Analysis of a table of embeddings."""
    return analyze(clip_frames(spark.read.parquet(path)), preset)
