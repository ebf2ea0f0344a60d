"""Weighted reciprocal-rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.blocks import KEYS
from folioscope.operators.spread import top_k

# Defaults of the hybrid search.
TOP_K = 20
POOL_SIZE = 70
RRF_K = 60.0
LEXICAL_WEIGHT = 1.5
SEMANTIC_WEIGHT = 1.0
NO_RANK = 10**9


def reciprocal_rank(rank: Column, rrf_k: float = RRF_K) -> Column:
    return 1.0 / (F.lit(float(rrf_k)) + rank)


def fuse(
    lexical: DataFrame,
    semantic: DataFrame,
    k: int = TOP_K,
    rrf_k: float = RRF_K,
    lexical_weight: float = LEXICAL_WEIGHT,
    semantic_weight: float = SEMANTIC_WEIGHT,
) -> DataFrame:
    """One ranking per query from both. A chunk that only one of them found counts with that rank alone."""
    left = lexical.select(
        "query_id", *KEYS, F.col("rank").alias("fts_rank"), F.col("score").alias("fts_score")
    )
    right = semantic.select(
        "query_id",
        *KEYS,
        F.col("rank").alias("embedding_rank"),
        F.col("similarity").alias("embedding_similarity"),
    )
    joined = left.join(right, ["query_id", *KEYS], "full_outer")
    by_text = F.coalesce(lexical_weight * reciprocal_rank(F.col("fts_rank"), rrf_k), F.lit(0.0))
    by_vector = F.coalesce(semantic_weight * reciprocal_rank(F.col("embedding_rank"), rrf_k), F.lit(0.0))
    scored = joined.withColumn("score", by_text + by_vector)
    order = [
        F.desc("score"),
        F.coalesce("fts_rank", F.lit(NO_RANK)).asc(),
        F.coalesce("embedding_rank", F.lit(NO_RANK)).asc(),
    ]
    ranked = top_k(scored, ["query_id"], order, k)
    return ranked.select(
        "query_id",
        "rank",
        "score",
        *KEYS,
        "fts_rank",
        "embedding_rank",
        "fts_score",
        "embedding_similarity",
    )
