"""The registered queries of this folder and their SQL. Each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    decontamination,
    divergence_audit,
    embedding_whitening,
    exact_dedup,
    jaccard_join,
    license_scan,
    line_dedup,
    pii_crf,
    quality_rules,
    secret_scan,
    source_mixing,
    suffix_dedup,
    template_extraction,
)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii_crf": op3_pii_crf,
    "op4_template_extraction": op4_template_extraction,
    "op5_license_scan": op5_license_scan,
    "op6_secret_scan": op6_secret_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLE: dict[str, str] = {
    "op2_quality_rules": quality_rules.oracle(),
    "op5_license_scan": license_scan.oracle(),
    "op6_secret_scan": secret_scan.oracle(),
    "op9_line_dedup": line_dedup.oracle(),
    "op10_decontamination": decontamination.oracle(),
    "op11_divergence_audit": divergence_audit.oracle(),
    "op13_exact_dedup": exact_dedup.oracle(),
}
