"""Hybrid search: BM25 and cosine rankings of the same queries, fused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from folioscope.operators import fusion, lexical, vectors


@dataclass(frozen=True)
class Rankings:
    lexical: DataFrame
    semantic: DataFrame
    fused: DataFrame


def search(
    index: DataFrame,
    embeddings: DataFrame,
    queries: DataFrame,
    model: str,
    k: int = fusion.TOP_K,
    pool_size: int = fusion.POOL_SIZE,
    prefer_reference: bool = False,
    rrf_k: float = fusion.RRF_K,
    lexical_weight: float = fusion.LEXICAL_WEIGHT,
    semantic_weight: float = fusion.SEMANTIC_WEIGHT,
    stats: lexical.IndexStats | None = None,
) -> Rankings:
    """``queries`` has query_id, query and vector; a query without a vector is searched by its text alone. With the
    stored ``stats`` of the index its terms are not counted again."""
    by_text = lexical.search(index, queries, pool_size, prefer_reference, stats=stats)
    by_vector = vectors.search(embeddings, queries.filter("vector IS NOT NULL"), model, pool_size)
    fused = fusion.fuse(by_text, by_vector, k, rrf_k, lexical_weight, semantic_weight)
    return Rankings(by_text, by_vector, fused)
