"""Stored tables in folders by hash of their key, of which a change rewrites only the folders it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioscope.session import materialize

PARTS = 64
FOLDER = "key_part"


@dataclass(frozen=True)
class KeyedTable:
    """Rows below ``path``, in folders by the columns ``by`` and by hash of ``key``. ``schema`` is that of the rows."""

    path: str
    key: str
    schema: StructType
    parts: int = PARTS
    by: tuple[str, ...] = ()

    @property
    def folders(self) -> tuple[str, ...]:
        return (*self.by, FOLDER)

    def part_of(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.parts)).cast("int")

    def _stored(self, spark: SparkSession) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(FOLDER, IntegerType())])
        return spark.read.schema(schema).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).select(*self.schema.names)

    def append(self, rows: DataFrame) -> None:
        """Add rows. Either all of them are there afterwards or none."""
        placed = rows.select(*self.schema.names).withColumn(FOLDER, self.part_of())
        placed.repartition(*self.folders).write.mode("append").partitionBy(*self.folders).parquet(self.path)

    def rewrite(self, keys: DataFrame, version: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the folders that hold ``keys`` (columns ``by`` and the key) by ``version`` of their rows.

        ``version`` gets the rows of these folders and must give rows that belong there; its result is written aside
        first, so an error in it leaves the table as it was. Then each folder is exchanged as a whole; no other folder is
        read or written. Returns the number of folders. The driver gets their names: at most ``parts`` for each value of
        ``by`` that changes.
        """
        spark = keys.sparkSession
        found = keys.select(*self.by, self.part_of().alias(FOLDER)).distinct()
        names = [tuple(row) for row in found.collect()]
        if not names:
            return 0
        touched = F.broadcast(spark.createDataFrame(names, found.schema))
        stored = self._stored(spark)
        # Literals of the folders prune the read; the pairs of several columns are matched by the join.
        for place, column in enumerate(self.folders):
            stored = stored.filter(F.col(column).isin(sorted({name[place] for name in names})))
        old = stored.join(touched, list(self.folders), "left_semi").select(*self.schema.names)
        made = version(old).select(*self.schema.names).withColumn(FOLDER, self.part_of())
        made = materialize(made.repartition(*self.folders), "version")
        strangers = made.select(*self.folders).distinct().join(touched, list(self.folders), "left_anti").count()
        if strangers:
            raise ValueError(f"the new version has rows of {strangers} other folders of {self.path}")
        filled = {tuple(row) for row in made.select(*self.folders).distinct().collect()}
        made.repartition(*self.folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *self.folders
        ).parquet(self.path)
        # A folder without rows is not part of what was written.
        self._drop(spark, set(names) - filled)
        return len(names)

    def _drop(self, spark: SparkSession, folders: set[tuple]) -> None:
        catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for values in folders:
            place = "/".join(
                catalog.getPartitionPathString(column, str(value)) for column, value in zip(self.folders, values)
            )
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(root, place), True)


def store(rows: DataFrame, path: str, key: str, parts: int = PARTS, by: Sequence[str] = ()) -> KeyedTable:
    """Write ``rows`` as a keyed table to a new ``path``."""
    table = KeyedTable(path.rstrip("/"), key, rows.schema, parts, tuple(by))
    table.append(rows)
    return table
