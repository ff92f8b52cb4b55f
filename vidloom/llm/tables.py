"""The test tables as the problems of the pipeline see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import relation_code, video_identity

SAME_CONTENT = ("identical", "identical_file", "near_duplicate_or_same_content")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same_content_links(pairs: DataFrame) -> DataFrame:
    """Identities ``a``, ``b`` of the report pairs that state that both videos have the same content."""
    p = pairs.where(relation_code("relation").isin(*SAME_CONTENT))
    p = p.select(video_identity("video_a_path").alias("a"), video_identity("video_b_path").alias("b"))
    return p.where(F.col("a").isNotNull() & F.col("b").isNotNull())
