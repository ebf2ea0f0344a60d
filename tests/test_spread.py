import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import blocks, lexical, spread, vectors


def test_attach_treats_heavy_keys_like_others(spark):
    rows = [(number, "hot" if number % 3 == 0 else f"k{number % 7}") for number in range(200)]
    df = spark.createDataFrame(rows, "n long, key string")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", None)], "key string, value int")
    heavy = spread.heavy_keys(df, "key", threshold=40)
    assert [row.key for row in heavy.collect()] == ["hot"]
    got = {row.n: row.value for row in spread.attach(df, lookup, "key", ["n"], heavy).collect()}
    assert got == {number: {"hot": 1, "k1": 2}.get(key) for number, key in rows}


@pytest.mark.parametrize("block", [3, 1024])
def test_running_matches_a_loop(spark, block):
    chooser = random.Random(5)
    rows = [
        (group, position, chooser.randint(0, 9))
        for group in range(4)
        for position in chooser.sample(range(1, 40), [1, 2, 20, 30][group])
    ]
    df = spark.createDataFrame(rows, "g long, p int, v long")
    got = {
        (row.g, row.p): (row.v_before, row.v_total)
        for row in spread.running(df, "g", "p", {"v": F.col("v")}, block).collect()
    }
    for group, position, _ in rows:
        same = [row for row in rows if row[0] == group]
        before = sum(value for _, other, value in same if other < position)
        assert got[group, position] == (before, sum(value for *_, value in same))


def test_attach_in_blocks_keeps_every_page(spark):
    rows = [(group, position) for group in (1, 2) for position in range(10)]
    df = spark.createDataFrame(rows, "g long, p int")
    lookup = spark.createDataFrame([(1, "a"), (3, "c")], "g long, name string")
    got = spread.attach_in_blocks(df, lookup, "g", "p", block=3).collect()
    assert sorted((row.g, row.p, row.name) for row in got) == [(1, position, "a") for position in range(10)]


def test_top_k_in_two_steps(spark):
    rows = [(number % 2, number * 7919 % 101, number) for number in range(100)]
    df = spark.createDataFrame(rows, "g int, score int, n int")
    order = [F.desc("score"), F.asc("n")]
    one = sorted(map(tuple, spread.top_k(df, ["g"], order, 5).collect()))
    two = sorted(map(tuple, spread.top_k(df, ["g"], order, 5, spread_by=["n"]).collect()))
    assert one == two and len(one) == 10


def test_many_passes_give_the_same_ranking(spark, monkeypatch):
    vecs = [(str(n), n, 0, "m", [float(n % 5), 1.0, float(n % 3)]) for n in range(40)]
    table = spark.createDataFrame(
        vecs, "chunk_id string, document_id long, chunk_index long, model string, embedding array<float>"
    )
    queries = spark.createDataFrame([(n, [1.0, float(n), 2.0]) for n in range(9)], "query_id long, vector array<double>")
    one = sorted(map(tuple, vectors.search(table, queries, "m", 4).collect()))
    monkeypatch.setattr(vectors, "PASS_BYTES", 50)
    monkeypatch.setattr(vectors, "CELLS", 20)
    assert sorted(map(tuple, vectors.search(table, queries, "m", 4).collect())) == one
    monkeypatch.setattr(vectors, "PASS_BYTES", 1 << 20)
    monkeypatch.setattr(blocks, "KEPT_ROWS", 12)
    assert sorted(map(tuple, vectors.search(table, queries, "m", 4).collect())) == one

    index = spark.createDataFrame(
        [(str(n), n, 0, "t", None, "s", [f"w{n % 4}", f"w{n % 7}", "all"], 5) for n in range(30)],
        "chunk_id string, document_id long, chunk_index long, document_type string, content_category string, "
        "chunk_strategy string, tokens array<string>, doc_len int",
    )
    asked = spark.createDataFrame([(n, f"w{n} w{n + 1} all") for n in range(6)], "query_id long, query string")
    whole = sorted(map(tuple, lexical.search(index, asked, 3).collect()))
    monkeypatch.setattr(lexical, "PASS_LIMIT", 5)
    assert sorted(map(tuple, lexical.search(index, asked, 3).collect())) == whole


@pytest.mark.parametrize("least", [1, 50, 100_000])
def test_best_rows_of_many_slices(monkeypatch, least):
    monkeypatch.setattr(blocks, "LEAST_CANDIDATES", least)
    rng = np.random.default_rng(least)
    score = rng.integers(0, 9, (60, 7)).astype(float)
    whole = rng.random((60, 7)) < 0.2
    best = blocks.BestRows(7, 4)
    for begin in range(0, 60, 5):
        part = range(begin, begin + 5)
        rows = pa.RecordBatch.from_pydict({"chunk_id": [str(n) for n in part], "document_id": list(part), "chunk_index": [0] * 5})
        row, query = np.nonzero(np.ones((5, 7), bool))
        value = score[begin + row, query]
        best.add(rows, query, row, whole[begin + row, query], value, value)
    got = {(row["query"], row["document_id"]) for batch in best.batches() for row in batch.to_pylist()}
    assert got == {
        (query, row)
        for query in range(7)
        for row in sorted(range(60), key=lambda row: (not whole[row, query], -score[row, query], row))[:4]
    }


def test_leaders_keep_ties():
    values = np.array([[1.0], [3.0], [3.0], [2.0], [-np.inf]])
    assert blocks.leaders(values, 1)[:, 0].tolist() == [False, True, True, False, False]
    assert blocks.leaders(values, 9)[:, 0].tolist() == [True, True, True, True, False]
