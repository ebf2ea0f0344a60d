import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluation, fusion, vectors
from folioscope.operators.hybrid import Rankings

EMBEDDED = "chunk_id string, document_id long, chunk_index long, model string, embedding array<float>"


def cosine(left, right):
    dot = sum(a * b for a, b in zip(left, right))
    norms = math.sqrt(sum(a * a for a in left)) * math.sqrt(sum(b * b for b in right))
    return dot / norms if norms else 0.0


def test_exact_ranking_with_ties_and_zero_vectors(spark):
    chooser = random.Random(1)
    vecs = [[float(chooser.randint(-2, 2)) for _ in range(3)] for _ in range(120)] + [[0.0] * 3]
    table = spark.createDataFrame(
        [(str(n), n, 0, "m", vec) for n, vec in enumerate(vecs)] + [("other", 1000, 0, "n", [9.0] * 3)], EMBEDDED
    )
    asked = [[1.0, 2.0, -1.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, vector array<double>")
    rows = vectors.search(table, queries, "m", 15).collect()
    for number, query in enumerate(asked):
        got = [row.document_id for row in sorted(rows, key=lambda row: row.rank) if row.query_id == number]
        want = sorted(range(len(vecs)), key=lambda n: (-round(cosine(query, vecs[n]), 12), n))[:15]
        assert got == want


def test_other_dimension_is_an_error(spark):
    table = spark.createDataFrame([("a", 1, 0, "m", [1.0, 2.0])], EMBEDDED)
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, vector array<double>")
    with pytest.raises(Exception, match="must have 3 values"):
        vectors.search(table, queries, "m").collect()


def test_cosine_expression_cuts_to_the_shorter(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [2.0, 1.0, 5.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>"
    )
    values = [row[0] for row in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert values == [pytest.approx(0.8), 0.0]


def stored(spark):
    chunks = spark.createDataFrame(
        [(f"c{n}", n, 0, "text " * n) for n in range(1, 41)],
        "chunk_id string, document_id long, chunk_index long, chunk_text string",
    )
    have = spark.createDataFrame(
        [(f"c{n}", "m", [1.0]) for n in range(1, 11)] + [("c11", "n", [1.0]), ("gone", "m", [1.0])],
        "chunk_id string, model string, embedding array<float>",
    )
    return chunks, have


def test_backfill_adds_what_is_missing_and_nothing_twice(spark):
    def lengths(texts):
        assert len(texts) <= 3
        return [[float(len(text)), 1.0] for text in texts]

    chunks, have = stored(spark)
    made = vectors.backfill(chunks, have, "m", lengths, batch_size=3)
    assert {row.chunk_id: row.embedding[0] for row in made.collect()} == {
        f"c{n}": 5.0 * n for n in range(11, 41)
    }
    merged = vectors.upsert_embeddings(have, made)
    assert vectors.missing_embeddings(chunks, merged, "m").count() == 0
    assert vectors.backfill(chunks, merged, "m", lengths, batch_size=3).count() == 0
    first = vectors.missing_embeddings(chunks, have, "m", limit=2)
    assert sorted(row.chunk_id for row in first.collect()) == ["c11", "c12"]


def test_backfill_checks_the_function(spark):
    chunks, have = stored(spark)
    for bad, message in ((lambda texts: [], "another number"), (lambda texts: [[] for _ in texts], "empty vector")):
        with pytest.raises(Exception, match=message):
            vectors.backfill(chunks, have, "m", bad).collect()


def test_coverage_counts_live_chunks(spark):
    rows = {row.model: row for row in vectors.coverage(*stored(spark)).collect()}
    assert (rows["m"].existing, rows["m"].dimension, rows["m"].missing) == (11, 1, 30)
    assert (rows["n"].existing, rows["n"].missing) == (1, 39)


def test_embeddings_are_stored_per_model(spark, tmp_path):
    _, have = stored(spark)
    vectors.write_embeddings(have, str(tmp_path / "e"))
    read = spark.read.parquet(str(tmp_path / "e")).filter("model = 'n'")
    assert read.count() == 1
    assert "PartitionFilters: [isnotnull(model" in read._jdf.queryExecution().toString()


def ranking(spark, rows, score):
    return spark.createDataFrame(
        [(1, rank, value, f"c{doc}", doc, 0) for rank, doc, value in rows],
        f"query_id long, rank int, {score} double, chunk_id string, document_id long, chunk_index long",
    )


def test_fusion(spark):
    left = ranking(spark, [(1, 10, 9.0), (2, 11, 8.0), (3, 12, 7.0)], "score")
    right = ranking(spark, [(1, 13, 0.9), (2, 10, 0.8), (3, 12, 0.7)], "similarity")
    rows = {row.document_id: row for row in fusion.fuse(left, right).collect()}
    assert rows[10].score == pytest.approx(1.5 / 61 + 1 / 62)
    assert rows[11].score == pytest.approx(1.5 / 62) and rows[11].embedding_rank is None
    assert rows[13].score == pytest.approx(1 / 61) and rows[13].fts_rank is None
    assert [doc for doc, _ in sorted(rows.items(), key=lambda item: item[1].rank)] == [10, 12, 11, 13]
    same = fusion.fuse(left, right, lexical_weight=1.0).filter("document_id in (11, 13)").orderBy("rank").collect()
    assert [row.document_id for row in same] == [13, 11]
    tied = fusion.fuse(
        ranking(spark, [(1, 20, 1.0)], "score"), ranking(spark, [(1, 21, 1.0)], "similarity"), lexical_weight=1.0
    )
    assert [row.document_id for row in tied.orderBy("rank").collect()] == [20, 21]
    assert fusion.fuse(left, right, k=2).count() == 2


def test_evaluation(spark):
    docs = spark.createDataFrame(
        [(n, f"Doc {n}.pdf", f"/r/x/Doc {n}.pdf") for n in range(30)], "id long, name string, path string"
    )
    asked = spark.createDataFrame(
        [(1, "a", ["dir/doc  1.PDF"]), (2, "b", ["doc 2.pdf", "doc 3.pdf"]), (3, "c", ["none.pdf"])],
        "query_id long, query string, known_relevant_documents array<string>",
    )

    def results(rows):
        return spark.createDataFrame(rows, "query_id long, rank int, document_id long")

    found = evaluation.evaluate(
        asked,
        Rankings(
            results([(1, 1, 9), (1, 2, 1), (2, 1, 3), (2, 2, 2)]),
            results([(1, 1, 1), (2, 4, 2), (3, 1, 5)]),
            results([(1, 3, 1), (2, 1, 2), (1, 11, 1)]),
        ),
        docs,
    )
    rows = {row.query_id: row for row in found.collect()}
    assert (rows[1].fts_rank, rows[1].embeddings_rank, rows[1].hybrid_rank, rows[1].winner) == (2, 1, 3, "embeddings")
    assert (rows[2].fts_rank, rows[2].embeddings_rank, rows[2].hybrid_rank, rows[2].winner) == (1, 4, 1, "tie")
    assert (rows[3].fts_rank, rows[3].winner) == (None, "tie")
    shares = {row.method: row for row in evaluation.summary(found).collect()}
    assert shares["fts"].hit_at_1 == pytest.approx(1 / 3) and shares["fts"].hit_at_3 == pytest.approx(2 / 3)
    assert {row.winner: row.queries for row in evaluation.winners(found).collect()} == {
        "fts": 0,
        "embeddings": 1,
        "hybrid": 0,
        "tie": 2,
    }
    with pytest.raises(ValueError):
        evaluation.evaluate(asked, None, docs, top_k=5)


def test_vectors_of_lost_documents_take_no_place(spark):
    chunks = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("c", 3, 0)], "chunk_id string, document_id long, chunk_index long")
    made = spark.createDataFrame([(key, "m", [1.0, float(n)]) for n, key in enumerate("abc")], "chunk_id string, model string, embedding array<float>")
    documents = spark.createDataFrame([(2,), (3,)], "id long")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query_id string, vector array<float>")
    found = vectors.search(vectors.locate(made, chunks, documents), queries, "m", 2).collect()
    assert sorted((row.rank, row.chunk_id) for row in found) == [(1, "b"), (2, "c")]
