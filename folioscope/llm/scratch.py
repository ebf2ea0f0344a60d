"""Intermediate tables in the shared folder, deleted once what was made from them is written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import shared_folder, ship_package


class Scratch:
    """A folder of tables of one call. A written table has no lineage: a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship_package(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            for file in table.inputFiles()[:1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of a batch that goes to or comes from the Python workers, for the jobs that run inside. A batch lies outside
    the JVM's heap, on both sides of the worker, so wide rows need small batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20):
    """Slices of a batch with at most so many bytes in a column, or one row where a row has more."""
    sizes = batch.column(column).nbytes
    if sizes <= most_bytes or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from batches_of(batch.slice(0, half), column, most_bytes)
    yield from batches_of(batch.slice(half), column, most_bytes)


def lower_ascii(text):
    """Lower-case A-Z only; letters outside ASCII stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
