"""Table sources and sinks between the stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.schemas import PAGES, QUERY_SET, conform, conform_documents


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    documents = conform_documents(spark.read.parquet(path))
    return documents.withColumn("document_type", F.coalesce("document_type", F.lit("unknown")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), PAGES)


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """Query set from JSON lines; rows may carry ``position`` to be named by. Files count in the order of their names."""
    rows = spark.read.schema(QUERY_SET).json(path)
    places = (F.col(f"_metadata.{name}").alias(f"source_{name}") for name in ("file_path", "file_block_start"))
    return query_set(rows.select("*", *places))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``number``, their place from 1: by file and split where the rows tell them, else by partition. Spark
    reads large files first, so partitions of files are in no useful order. Only one count per split is ordered."""
    by = [name for name in ("source_file_path", "source_file_block_start") if name in rows.columns]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    if not by:
        by = ["part"]
        placed = placed.withColumn("part", F.expr("shiftright(place, 33)"))
    counts = placed.groupBy(*by).agg(F.count("*").alias("rows"))
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    numbered = placed.withColumn("inside", inside).join(F.broadcast(starts), by)
    return numbered.withColumn("number", F.col("start") + F.col("inside")).drop("place", "inside", "start", *by)


def query_set(rows: DataFrame) -> DataFrame:
    """Check a query set: no query is empty, each names a relevant document, and no id is there twice.

    A query without id is named by its ``position``, or without one by its place in the rows. A bad row fails the job,
    whichever columns are read.
    """
    position = F.coalesce(F.col("position").cast("long"), F.col("number"))
    query = strip(F.col("query"))
    named = F.coalesce(F.size("known_relevant_documents"), F.lit(0)) > 0
    label = F.concat(F.lit("query item #"), position.cast("string"))
    given = F.coalesce(F.nullif(F.col("query_id"), F.lit("")), F.format_string("q%03d", position))
    rows = _numbered(rows).withColumn("query_id", given)
    rows = rows.withColumn("same_id", F.count("*").over(Window.partitionBy("query_id")))
    checked = (
        F.when(F.coalesce(query, F.lit("")) == "", F.raise_error(F.concat(label, F.lit(" has no query"))))
        .when(~named, F.raise_error(F.concat(label, F.lit(" has no known_relevant_documents"))))
        .when(F.col("same_id") > 1, F.raise_error(F.concat(label, F.lit(" repeats the id "), F.col("query_id"))))
        .otherwise(F.col("query_id"))
    )
    return rows.select(
        checked.alias("query_id"),
        query.alias("query"),
        "known_relevant_documents",
        *(
            F.nullif(F.col(name), F.lit("")).alias(name)
            for name in ("category", "evaluation_mode", "relevance_confidence")
        ),
    )


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a table beside ``path``, then put it there. What is written may be made from what is there now.

    Until the new table is whole the old one is untouched; between the two renames it has another name beside it.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    beside = {kind: target.suffix(f"__{kind}-{mark}") for kind in ("new", "old")}
    write(beside["new"].toString())
    if system.exists(target) and not system.rename(target, beside["old"]):
        raise OSError(f"cannot move {path}; the new table is in {beside['new'].toString()}")
    if not system.rename(beside["new"], target):
        system.rename(beside["old"], target)
        raise OSError(f"cannot put the new table at {path}")
    if system.exists(beside["old"]):
        system.delete(beside["old"], True)


def overwrite(table: DataFrame, path: str) -> None:
    replace(table.sparkSession, path, table.write.parquet)


def write_json_lines(results: DataFrame, path: str) -> None:
    replace(results.sparkSession, path, results.write.json)
