"""The queries of this subpackage and, where SQL can say them on whole tables, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidlens.llm import (
    byte_bpe, decontamination, filter_audit, html_extraction, jaccard_join, quality_crf, quality_rules, sharding, source_audit, substring_dedup,
    token_counts, toxicity, vector_search,
)
from bidlens.llm.tables import read


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_table(read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_table(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_table(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_table(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.page_table(read(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_table(read(spark, sf_dir, "documents"))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_token_counts, op3_jaccard_join, op4_toxicity, op5_decontamination, op6_quality_crf, op7_substring_dedup, op8_byte_bpe,
        op9_html_extraction, op10_quality_rules, op11_vector_search, op12_filter_audit, op13_source_audit,
    )
}
ORACLES = {
    "op1_sharding": sharding.SQL, "op10_quality_rules": quality_rules.SQL, "op11_vector_search": vector_search.SQL, "op12_filter_audit": filter_audit.SQL,
    "op13_source_audit": source_audit.SQL,
}
