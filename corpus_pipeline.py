"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontamination, jaccard_join, line_dedup, quality_rules, source_mixing
from folioscope.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the votes of the quality rules find bad go."""
    return quality_rules.good_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large part of a source's documents carry are cut; ``n_chars`` follows the text."""
    cleaned = line_dedup.without_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest id.

    Where ids repeat, rows are grouped by a number of their own: each goes by its own text, and of rows equal in id and
    text one stays. Rows without an id or without words belong to no group and stay.
    """
    named = docs.filter("doc_id is not null")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        groups = jaccard_join.similar_groups(docs.select("doc_id", "text"))
        others = groups.filter("component_id < doc_id").select("doc_id")
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    scratch = Scratch(spark, "near")
    row = next(name for n in range(99) if (name := "row_number" + "_" * n) not in map(str.lower, docs.columns))
    numbered = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    number = F.when(F.col("doc_id").isNotNull(), F.col(row))
    groups = jaccard_join.similar_groups(numbered.select(number.alias("doc_id"), "text"))
    members = groups.filter("doc_id is not null").select(F.col("doc_id").alias(row), "component_id")
    members = scratch.write(members, "members")
    # Components of one row have nothing to drop; sizes are combined before the shuffle.
    several = members.groupBy("component_id").agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    ids = members.join(several, "component_id").join(numbered.select(row, "doc_id"), row)
    ids = scratch.write(ids, "ids")
    stays = ids.groupBy("component_id").agg(F.min_by(row, F.struct("doc_id", row)).alias("stays"))
    gone = ids.join(stays, "component_id").filter(F.col(row) != F.col("stays")).select(row)
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot in the mix of sources."""
    return source_mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", benchmark),
    ("source_mixing", mixing),
]
# Groups of near duplicates and the schedule of the mix are not expressible in SQL at this size.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        written = scratch.write(stage(spark, docs, sf_dir), name)
        docs = written
    return docs
