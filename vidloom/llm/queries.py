"""Queries of the llm problems: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import video_identity
from . import chunking, forest, mixing, packing, representative, scenes, topn
from .components import linked_groups
from .tables import read, same_content_links

Query = Callable[[SparkSession, str], DataFrame]


def limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """``size_limits``, a settings table of three rows."""
    return {r["limit_name"]: int(r["tokens"]) for r in read(spark, sf_dir, "size_limits").collect()}


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return linked_groups(same_content_links(read(spark, d, "report_pairs")), "a", "b", "video_path", "group_path")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fields = representative.video_fields(read(spark, d, "videos"), read(spark, d, "report_pairs"))
    return representative.survivors(_groups(spark, d), fields, group="group_path", member="video_path", keeper="keeper_path")


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The most typical video name of every group, each name weighted by the number of its scans."""
    names = read(spark, d, "videos").select("scan_id", video_identity("video_path").alias("video_path"), "video_name")
    names = names.where("video_name is not null").groupBy("scan_id", "video_path", "video_name").count()
    names = names.join(_groups(spark, d), "video_path").groupBy("group_path", "video_name").agg(F.count(F.lit(1)).alias("scans"))
    out = representative.consensus_values(names, "group_path", "video_name", "scans")
    return out.select(F.col("group").alias("group_path"), "consensus", F.col("value").alias("video_name"), "distance", F.col("values").alias("n_values"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = forest.neighbours(read(spark, d, "frames"), k=5, min_similarity=0.95)
    return near.select(F.least("id", "neighbour").alias("frame_id_lo"), F.greatest("id", "neighbour").alias("frame_id_hi")).distinct()


def p3_search(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar frames of every frame whose id is divisible by 100, against all frames."""
    frames = read(spark, d, "frames")
    found = forest.search(frames, frames.where(F.col("frame_id") % 100 == 0).select("frame_id"), k=5)
    return found.select(F.col("id").alias("frame_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scenes.scenes(read(spark, d, "frames")).select(F.col("id").alias("frame_id"), F.col("cluster").alias("cluster_id"))


def p5_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Size and five most typical frames of every scene."""
    out = scenes.describe(scenes.scenes(read(spark, d, "frames")))
    return out.select(F.col("cluster").alias("cluster_id"), "size", "rank", F.col("id").alias("frame_id"), F.round("similarity", 5).alias("similarity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top(spark, d).select("match_id")


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    """The best matches of every source frame with their rank."""
    return topn.candidate_matches(read(spark, d, "frame_matches"), read(spark, d, "report_pairs"), read(spark, d, "analysis_config"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(mixing.sized_documents(read(spark, d, "documents")), limits(spark, d)["container_capacity"])


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers have how much unused space."""
    room = limits(spark, d)["container_capacity"]
    c = p7_pack(spark, d).groupBy("container").agg(F.sum("tokens").alias("fill"))
    return c.groupBy((F.lit(room) - F.col("fill")).alias("slack")).agg(F.count(F.lit(1)).alias("containers"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.sized_documents(read(spark, d, "documents")), read(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].where("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    size = limits(spark, d)
    return chunking.split_oversized(read(spark, d, "documents"), size["piece_limit"], size["piece_overlap"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    size = limits(spark, d)
    pieces = chunking.split_oversized(read(spark, d, "documents"), size["piece_limit"], size["piece_overlap"], with_text=False)
    return pieces.where("piece = 1").select("doc_id").distinct()


def queries() -> dict[str, Query]:
    found = (p1_found, p2_found, p2_consensus, p3_found, p3_search, p5_found, p5_scenes, p6_found, p6_top, p7_pack, p7_fill, p8_found, p8_mix, p8_shares, p9_found, p9_pieces)
    return {f.__name__: f for f in found}


