"""Retrieval evaluation: first relevant rank per query and method, Hit@k and winners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import document_name
from folioscope.operators.hybrid import Rankings

# Cutoffs, methods and the pool of an evaluation run.
CUTOFFS = (1, 3, 5, 10)
METHODS = ("fts", "embeddings", "hybrid")
POOL_SIZE = 50


def relevant_names(query_set: DataFrame) -> DataFrame:
    named = query_set.select("query_id", F.explode("known_relevant_documents").alias("document"))
    return named.select("query_id", document_name(F.col("document")).alias("document_name")).distinct()


def first_hits(query_set: DataFrame, results: DataFrame, documents: DataFrame, top_k: int) -> DataFrame:
    """Smallest rank with a relevant document per query and method, by file name or by the name in the path."""
    names = documents.select(
        F.col("id").alias("document_id"),
        F.explode(
            F.array_distinct(F.array(document_name(F.col("name")), document_name(F.col("path"))))
        ).alias("document_name"),
    )
    seen = results.filter(F.col("rank") <= top_k).select("method", "query_id", "rank", "document_id")
    hits = seen.join(names, "document_id").join(
        relevant_names(query_set), ["query_id", "document_name"], "left_semi"
    )
    return hits.groupBy("query_id", "method").agg(F.min("rank").alias("first_hit_rank"))


def hit_at(rank: Column, cutoff: int) -> Column:
    return F.coalesce(rank <= cutoff, F.lit(False)).cast("int")


def hit_vector(rank: Column) -> Column:
    return F.concat_ws(
        " ", *(F.concat(F.lit(f"Hit@{cutoff}="), hit_at(rank, cutoff).cast("string")) for cutoff in CUTOFFS)
    )


def evaluate(query_set: DataFrame, rankings: Rankings, documents: DataFrame, top_k: int = 10) -> DataFrame:
    """One row per query: first relevant rank per method and the method that found it first, else tie."""
    if top_k < max(CUTOFFS):
        raise ValueError(f"top_k must be at least {max(CUTOFFS)}")
    ranked = zip(METHODS, (rankings.lexical, rankings.semantic, rankings.fused))
    # One pass over documents and known names for all methods.
    results = reduce(
        DataFrame.unionByName,
        (rows.select(F.lit(method).alias("method"), "query_id", "rank", "document_id") for method, rows in ranked),
    )
    hits = first_hits(query_set, results, documents, top_k)
    per_method = hits.groupBy("query_id").agg(
        *(F.min(F.when(F.col("method") == method, F.col("first_hit_rank"))).alias(f"{method}_rank") for method in METHODS)
    )
    joined = query_set.select("query_id", "query").join(per_method, "query_id", "left")
    ranks = [F.col(f"{method}_rank") for method in METHODS]
    best = F.least(*ranks)
    shared = sum((F.coalesce((rank == best).cast("int"), F.lit(0)) for rank in ranks), F.lit(0))
    winner = reduce(
        lambda chain, method: chain.when((shared == 1) & (F.col(f"{method}_rank") == best), method),
        METHODS[1:],
        F.when((shared == 1) & (ranks[0] == best), METHODS[0]),
    )
    return joined.withColumn("winner", winner.otherwise("tie"))


def summary(evaluation: DataFrame) -> DataFrame:
    """Share of queries with a relevant document within each cutoff, per method."""
    methods = F.array(
        *(
            F.struct(F.lit(method).alias("method"), F.col(f"{method}_rank").alias("rank"))
            for method in METHODS
        )
    )
    long = evaluation.select(F.explode(methods).alias("hit")).select("hit.method", "hit.rank")
    return long.groupBy("method").agg(
        F.count("*").alias("queries"),
        *(F.avg(hit_at(F.col("rank"), cutoff)).alias(f"hit_at_{cutoff}") for cutoff in CUTOFFS),
    )


def winners(evaluation: DataFrame) -> DataFrame:
    """Queries won per method; methods that never won are kept with 0."""
    totals = evaluation.agg(
        *(F.count_if(F.col("winner") == name).alias(name) for name in (*METHODS, "tie"))
    )
    return totals.unpivot([], [*METHODS, "tie"], "winner", "queries")
