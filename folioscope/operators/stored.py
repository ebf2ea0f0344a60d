"""Stored tables of a corpus that a search reads in part: postings by bucket of their term, chunks by part of their document.

Postings lie in folders by term bucket, so a query reads the folders of its words. Within a folder they are bucketed by
chunk: all postings of a chunk are read by one task, whatever folders they come from, and a term that occurs in a third of
the chunks lies in as many files as every other. Chunks lie in folders by document; the text of a ranking's rows is fetched
from the folders of its documents.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import materialize, shared_folder

CHUNK = ("document_id", "chunk_index")
# Chunks whose postings one task reads, and bounds of the two numbers of buckets. Files: terms x chunks buckets. A small
# index has a bucket for every 2,000 chunks, up to eight.
CHUNKS_PER_TASK = 8_000
SMALL_CHUNKS, SMALL_BUCKETS, MOST_CHUNK_BUCKETS = 2_000, 8, 8_192
CHUNKS_PER_TERM_BUCKET = 1_000_000
LEAST_TERM_BUCKETS, MOST_TERM_BUCKETS = 8, 1_024
# Folders of the chunk table.
PARTS = 64
MOST_PARTS = 4_096


def _bounded(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


@dataclass(frozen=True)
class PartedTable:
    """A table in folders by hash of a key."""

    table: DataFrame
    key: str
    parts: int

    def part_of(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.parts)).cast("int")

    def of_parts(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        """The folders that hold the keys of ``rows`` (a written table). Their numbers, at most ``parts``, are all that
        the driver gets."""
        found = rows.select(self.part_of(key).alias("part")).distinct().collect()
        return self.table.filter(F.col("part").isin([row.part for row in found]))


def store_parted(rows: DataFrame, key: str, path: str, parts: int = PARTS) -> PartedTable:
    """Write ``rows`` in ``parts`` folders. A folder with more rows than others is cut into more files."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    placed = rows.withColumn("part", part).repartition("part", F.pmod(F.xxhash64(*CHUNK), F.lit(8)))
    placed.write.partitionBy("part").parquet(path)
    schema = placed.schema
    return PartedTable(spark.read.schema(schema).parquet(path), key, parts)


@dataclass(frozen=True)
class StoredIndex:
    """An index that was written: ``postings`` (term, document_id, chunk_index, tf, positions, doc_len, document_type,
    content_category, chunk_strategy, bucket), ``terms`` (term, df, bucket), ``chunks`` (chunk_id by document) and
    ``corpus`` (n_chunks, total_len, avg_len), of which the first two are at hand as numbers."""

    postings: DataFrame
    terms: DataFrame
    chunks: PartedTable
    corpus: DataFrame
    buckets: int
    n_chunks: int
    total_len: int

    def bucket_of(self, term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def located(self, words: DataFrame) -> tuple[DataFrame, list[int]]:
        """Query words (a local table with a column term) with their buckets, and the numbers of these buckets."""
        placed = words.withColumn("bucket", self.bucket_of("term"))
        rows = placed.collect()
        return words.sparkSession.createDataFrame(rows, placed.schema), sorted({row.bucket for row in rows})

    def postings_of(self, words: DataFrame, buckets: Sequence[int]) -> DataFrame:
        """Postings of the terms in ``words`` (located), read from their buckets only."""
        return self.postings.filter(F.col("bucket").isin(list(buckets))).join(F.broadcast(words), ["bucket", "term"])

    def terms_of(self, words: DataFrame, buckets: Sequence[int]) -> DataFrame:
        return self.terms.filter(F.col("bucket").isin(list(buckets))).join(F.broadcast(words), ["bucket", "term"])


def _bucketed(spark: SparkSession, path: str, schema: str, chunk_buckets: int) -> DataFrame:
    """A table over the files at ``path``. Its name lives as long as the session; the files are what is stored."""
    name = f"postings_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY (bucket) CLUSTERED BY ({', '.join(CHUNK)}) "
        f"SORTED BY (term) INTO {chunk_buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def store_index(
    index: DataFrame,
    invert: Callable[[DataFrame], DataFrame],
    path: str | None = None,
    chunk_buckets: int | None = None,
) -> StoredIndex:
    """Write an index (rows of ``lexical.build_index``, a written table) and the postings that ``invert`` makes of its rows,
    with the columns named above. The number of ``chunk_buckets`` follows from that of the chunks unless it is given.

    Rows are shuffled once, by chunk, before they are inverted; each task writes its chunks' part of every term bucket,
    sorted by term.
    """
    spark = index.sparkSession
    path = (path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
    corpus = materialize_at(
        index.agg(
            F.count("*").alias("n_chunks"),
            F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"),
            F.avg("doc_len").alias("avg_len"),
        ),
        f"{path}/corpus",
    )
    totals = corpus.first()
    n_chunks = totals.n_chunks
    least = _bounded(math.ceil(n_chunks / SMALL_CHUNKS), 1, SMALL_BUCKETS)
    chunk_buckets = chunk_buckets or _bounded(math.ceil(n_chunks / CHUNKS_PER_TASK), least, MOST_CHUNK_BUCKETS)
    buckets = _bounded(math.ceil(n_chunks / CHUNKS_PER_TERM_BUCKET), LEAST_TERM_BUCKETS, MOST_TERM_BUCKETS)
    postings = invert(index.repartition(chunk_buckets, *CHUNK))
    placed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    name = f"written_{uuid.uuid4().hex}"
    (
        placed.write.partitionBy("bucket")
        .bucketBy(chunk_buckets, *CHUNK)
        .sortBy("term")
        .option("path", f"{path}/postings")
        .saveAsTable(name)
    )
    counted = spark.table(name).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    parts = _bounded(math.ceil(n_chunks / CHUNKS_PER_TERM_BUCKET), LEAST_TERM_BUCKETS, MOST_PARTS)
    store_parted(index.select("chunk_id", *CHUNK), "document_id", f"{path}/chunks", parts)
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in placed.schema)
    facts = {
        "buckets": buckets,
        "chunk_buckets": chunk_buckets,
        "parts": parts,
        "schema": schema,
        "n_chunks": n_chunks,
        "total_len": totals.total_len,
    }
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.text(f"{path}/facts")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """The index that ``store_index`` wrote to ``path``, in this session or another."""
    path = path.rstrip("/")
    facts = json.loads(spark.read.text(f"{path}/facts").first().value)
    key = "chunk_id string, document_id long, chunk_index long, part int"
    return StoredIndex(
        _bucketed(spark, f"{path}/postings", facts["schema"], facts["chunk_buckets"]),
        spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms"),
        PartedTable(spark.read.schema(key).parquet(f"{path}/chunks"), "document_id", facts["parts"]),
        spark.read.schema("n_chunks long, total_len long, avg_len double").parquet(f"{path}/corpus"),
        facts["buckets"],
        facts["n_chunks"],
        facts["total_len"],
    )


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_chunks(chunks: DataFrame, path: str | None = None, parts: int = PARTS) -> PartedTable:
    """The chunk table in folders by document, for ``fetch``."""
    spark = chunks.sparkSession
    return store_parted(chunks, "document_id", path or f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}", parts)


def fetch(rows: DataFrame, stored: PartedTable, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` of their chunks, read from the folders of their documents only.

    ``rows`` is small (a ranking): it is written first, then its documents name the folders, and it is matched with them by
    document and chunk.
    """
    written = materialize(rows, "rows")
    found = stored.of_parts(written, "document_id").select("part", *CHUNK, *columns)
    keyed = written.withColumn("part", stored.part_of("document_id"))
    return keyed.join(found, ["part", *CHUNK]).select(*rows.columns, *columns)
