"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import centroids, chat, decontaminate, html, licenses, media, mixing, near_duplicates, oracles, pii, quality, resampling, topk, toxicity
from mnemolake.llm.common import table


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "block")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    said = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat.conversation_digests(rows.unionByName(said))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal_data(table(spark, sf_dir, "documents"))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other rows for each row whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": media_columns,
    "op2_mixing_sources": mixing_sources,
    "op3_chat_formatting": chat_formatting,
    "op4_benchmark_decontamination": benchmark_decontamination,
    "op5_html_extraction": html_extraction,
    "op6_toxicity": toxicity_scores,
    "op7_personal_data": personal_data,
    "op8_near_duplicates": near_duplicate_classes,
    "op9_quality": quality_scores,
    "op10_license_scans": license_scans,
    "op11_importance_resampling": importance_resampling,
    "op12_exact_top_k": exact_top_k,
    "op13_centroid_clusters": centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing_sources": oracles.MIXING,
    "op3_chat_formatting": oracles.CHAT,
    "op4_benchmark_decontamination": oracles.DECONTAMINATION,
    "op10_license_scans": oracles.license_sql(),
    "op11_importance_resampling": oracles.resampling_sql(),
    "op12_exact_top_k": oracles.TOP_K,
    "op13_centroid_clusters": oracles.centroid_sql(),
}
