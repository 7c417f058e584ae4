"""The queries of this subpackage and, where SQL can express one, the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, html_text, langid, near_dedup, pieces, secret_scan, substring_dedup, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (document, benchmark item) pairs that leak."""
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("segments")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(_read(spark, sf_dir, "documents"), words=2)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.page_verdicts(_read(spark, sf_dir, "pages"), url_filter.entries(spark))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_read(spark, sf_dir, "documents")).drop("removed")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number and whether decoding gives the text back."""
    return pieces.encode_documents(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(_read(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_benchmark_decontamination, op2_toxicity, op3_secret_scan, op4_minhash_near_dedup, op5_url_filter, op6_substring_dedup, op7_embedding_near_dedup, op8_sentencepiece, op9_language_id, op10_html_text)
}
SQL: dict[str, str] = {"op1_benchmark_decontamination": decontaminate.SQL, "op5_url_filter": url_filter.SQL}
