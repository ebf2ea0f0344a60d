"""Exact cosine search over chunk embeddings, and the embedding backfill."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.blocks import BEST_SCHEMA, KEYS, BestRows, in_blocks, leaders, slices
from folioscope.operators.spread import top_k
from folioscope.session import materialize, shared_folder
from folioscope.sources.keyed import PARTS, KeyedTable, store
from folioscope.sources.tables import replace

# Bytes of query vectors that one pass hands to every task.
PASS_BYTES = 64 << 20
# Cells of the similarity matrix a task fills at a time.
CELLS = 2_000_000
SIMILARITY_DIGITS = 12
BATCH = 16
# Chunks embedded between two commits of a stored backfill.
COMMIT_ROWS = 100_000


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors in double precision; 0 for a zero vector, the longer one cut to the shorter."""
    size = F.least(F.size(left), F.size(right))
    one = F.transform(F.slice(left, 1, size), lambda value: value.cast("double"))
    two = F.transform(F.slice(right, 1, size), lambda value: value.cast("double"))

    def dot(first: Column, second: Column) -> Column:
        products = F.zip_with(first, second, lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)

    norms = F.sqrt(dot(one, one)) * F.sqrt(dot(two, two))
    return F.when(norms == 0, 0.0).otherwise(dot(one, two) / F.nullif(norms, F.lit(0.0)))


def matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(vectors) * dimension:
        raise ValueError(f"every vector must have {dimension} values")
    return flat.reshape(len(vectors), dimension)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _scorer(shared, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        n_queries, dimension = queries.shape
        best = BestRows(n_queries, k)
        for batch in (part for whole in batches for part in slices(whole, max(1, CELLS // n_queries))):
            similarity = unit_rows(matrix(batch["embedding"], dimension)) @ queries.T
            similarity = np.round(similarity, SIMILARITY_DIGITS)
            row, query = np.nonzero(leaders(similarity, k) & (similarity >= best.floor[:, 1]))
            value = similarity[row, query]
            best.add(batch, query, row, np.zeros(len(row)), value, value)
        yield from best.batches()

    return score


def _search_pass(embeddings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = embeddings.sparkSession
    block = queries.select("query_id", "vector").toArrow().combine_chunks()
    kind = queries.schema["query_id"].dataType.simpleString()
    names = spark.createDataFrame(list(enumerate(block["query_id"].to_pylist())), f"query int, query_id {kind}")
    if block.num_rows == 0:
        return spark.createDataFrame([], BEST_SCHEMA).join(names, "query")
    vectors = block["vector"].combine_chunks()
    dimension = vectors.value_lengths()[0].as_py()
    shared = spark.sparkContext.broadcast(unit_rows(matrix(vectors, dimension)))
    scored = embeddings.select(*KEYS, "embedding").mapInArrow(_scorer(shared, k), BEST_SCHEMA)
    return scored.join(F.broadcast(names), "query")


def search(embeddings: DataFrame, queries: DataFrame, model: str, k: int = 10) -> DataFrame:
    """Ranked chunks per query by cosine similarity, over every vector of ``model``.

    ``embeddings`` has chunk_id, document_id, chunk_index, model and embedding; ``queries`` has query_id and vector.
    Vectors of another dimension than the queries are an error; a query without a vector has no results.
    """
    queries = queries.filter(F.col("vector").isNotNull())
    of_model = embeddings.filter(F.col("model") == model)
    scored = in_blocks(
        queries.select("query_id", "vector"),
        F.size("vector") * 8,
        PASS_BYTES,
        k,
        lambda block: _search_pass(of_model, block, k),
    )
    order = [F.desc("ranking"), F.asc("document_id"), F.asc("chunk_index")]
    ranked = top_k(scored, ["query_id"], order, k, "rank", ["chunk_id"])
    return ranked.select("query_id", "rank", F.col("ranking").alias("similarity"), *KEYS)


def locate(embeddings: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Embeddings with the position of their chunk; vectors whose chunk has gone, or its document, are left out."""
    if documents is not None:
        chunks = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return embeddings.join(chunks.select(*KEYS), "chunk_id")


def missing_embeddings(
    chunks: DataFrame, embeddings: DataFrame, model: str, limit: int | None = None
) -> DataFrame:
    done = embeddings.filter(F.col("model") == model).select("chunk_id")
    missing = chunks.join(done, "chunk_id", "left_anti").select(*KEYS, "chunk_text")
    return missing if limit is None else missing.orderBy("document_id", "chunk_index").limit(limit)


def coverage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per model: vectors, their dimension, and chunks still without one."""
    n_chunks = chunks.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    live = chunks.select("chunk_id").withColumn("live", F.lit(1))
    per_model = (
        embeddings.join(live, "chunk_id", "left")
        .groupBy("model")
        .agg(
            F.count("*").alias("existing"),
            F.max(F.size("embedding")).alias("dimension"),
            F.count("live").alias("covered"),
        )
        .withColumn("one", F.lit(1))
    )
    return per_model.join(n_chunks, "one").select(
        "model", "existing", "dimension", (F.col("n") - F.col("covered")).alias("missing")
    )


def upsert_embeddings(existing: DataFrame, new: DataFrame) -> DataFrame:
    kept = existing.join(new.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def store_embeddings(embeddings: DataFrame, path: str, parts: int = PARTS) -> KeyedTable:
    """Embeddings in folders by model and by hash of the chunk: a search opens the files of its model, an upsert those of
    its chunks."""
    return store(embeddings, path, "chunk_id", parts, ["model"])


def upsert_stored(table: KeyedTable, new: DataFrame) -> int:
    """``upsert_embeddings`` in a stored table. Other models and other folders of the model stay as they are."""
    return table.rewrite(new, lambda old: upsert_embeddings(old, new))


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """One folder per model, so a search opens only the files of its model."""
    replace(embeddings.sparkSession, path, embeddings.write.partitionBy("model").parquet)


def _embedder(embed: Callable[[list[str]], Sequence[Sequence[float]]], batch_size: int):
    def embed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, batch_size)):
            vectors = [list(vector) for vector in embed(part["chunk_text"].to_pylist())]
            if len(vectors) != part.num_rows:
                raise ValueError("the embedding function returned another number of vectors than texts")
            if not all(vectors):
                raise ValueError("the embedding function returned an empty vector")
            yield pa.RecordBatch.from_arrays(
                [part["chunk_id"], pa.array(vectors, pa.list_(pa.float32()))], names=["chunk_id", "embedding"]
            )

    return embed_rows


def _embedded(missing: DataFrame, model: str, embed, batch_size: int) -> DataFrame:
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    texts = missing.select("chunk_id", "chunk_text")
    made = texts.mapInArrow(_embedder(embed, batch_size), "chunk_id string, embedding array<float>")
    return made.select(
        "chunk_id",
        F.lit(model).alias("model"),
        "embedding",
        F.size("embedding").alias("dimension"),
        F.current_timestamp().alias("created_at"),
    )


def backfill(
    chunks: DataFrame,
    embeddings: DataFrame,
    model: str,
    embed: Callable[[list[str]], Sequence[Sequence[float]]],
    limit: int | None = None,
    batch_size: int = BATCH,
) -> DataFrame:
    """Vectors for the chunks that have none, from the caller's ``embed``, called with ``batch_size`` texts."""
    return _embedded(missing_embeddings(chunks, embeddings, model, limit), model, embed, batch_size)


def backfill_stored(
    chunks: DataFrame,
    table: KeyedTable,
    model: str,
    embed: Callable[[list[str]], Sequence[Sequence[float]]],
    batch_size: int = BATCH,
    commit_rows: int = COMMIT_ROWS,
) -> int:
    """``backfill`` into a stored table, committed about every ``commit_rows`` chunks. Returns the number of commits.

    What was committed before an error stays: the next call finds those chunks embedded and goes on with the rest. The
    chunks to do are written once, in a folder for each commit.
    """
    spark = chunks.sparkSession
    missing = missing_embeddings(chunks, table.read(spark), model).select("chunk_id", "chunk_text")
    found = materialize(missing, "missing")
    commits = math.ceil(found.count() / commit_rows)
    if not commits:
        return 0
    turn = F.pmod(F.xxhash64("chunk_id", F.lit(model)), F.lit(commits)).cast("int")
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    found.withColumn("turn", turn).write.partitionBy("turn").parquet(path)
    turns = spark.read.schema("chunk_id string, chunk_text string, turn int").parquet(path)
    for number in range(commits):
        part = _embedded(turns.filter(F.col("turn") == number), model, embed, batch_size)
        # A table may hold fewer columns, or more.
        present = [F.col(name) if name in part.columns else F.lit(None).alias(name) for name in table.schema.names]
        table.append(part.select(*present))
    return commits
