"""Registered queries of the training-data operators: each over its whole table, with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import CLUSTER_SQL, cluster_vectors
from .common import table
from .decontaminate import find_leaks
from .divergence import AUDIT_SQL, audit_sources
from .html_text import extract_pages
from .language import language_rows
from .licenses import scan_licenses
from .neardup import near_duplicates
from .packing import packing_rows
from .pii import find_personal_data
from .quality import judge_documents
from .sharding import shard_documents
from .token_store import token_rows
from .tree_weighting import score_documents


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_rows(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_rows(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).drop("class_key")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_html_text, op3_token_store, op4_packing, op5_near_duplicates, op6_sharding, op7_decontamination, op8_quality,
        op9_licenses, op10_personal_data, op11_language_model, op12_centroids, op13_source_divergence,
    )
}

# The other operators cannot be written in SQL as a whole (trained models, tokenizers, sketches, checksums); each is tested
# against a brute-force version instead.
ORACLES: dict[str, str] = {"op12_centroids": CLUSTER_SQL, "op13_source_divergence": AUDIT_SQL}
