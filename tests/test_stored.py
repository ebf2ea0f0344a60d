"""Stored postings and chunks: what is read, and that results stay those of SQLite's full-text index."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_lexical import Fts, corpus, tables

from folioscope.operators import lexical, stored, vectors
from folioscope.operators.blocks import shares


@pytest.fixture(scope="module")
def built(spark):
    rows = corpus(11, 150)
    docs, chunks = tables(spark, rows)
    index = lexical.build_index(chunks, docs).persist()
    return rows, docs, chunks, index, lexical.store(index, chunk_buckets=6)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_phrases_over_positions(spark, built):
    rows, _, _, _, index = built
    texts = ["foo_bar_grid", "the_the", "the_the_the йод", "foo_bar the_the", "Foo_Bar_foo_bar", "it's_the", "grid_nowhere"]
    found = lexical.search(index, asked(spark, texts), k=150).collect()
    fts = Fts(rows)
    for number, text in enumerate(texts):
        got = {row.document_id: row.score for row in found if row.query_id == number}
        want = fts.search(text)
        assert got.keys() == want.keys(), text
        assert all(got[key] == pytest.approx(want[key], abs=1e-9) for key in got), text
    assert {row.query_id for row in found} >= {0, 1, 2, 3, 4}


def test_a_word_reads_its_bucket(spark, built):
    index = built[4]
    assert index.buckets > 1
    word, buckets = index.located(spark.createDataFrame([(0, "grid")], "unit int, term string"))
    [bucket] = buckets
    read = index.postings_of(word, buckets)
    files = read.inputFiles()
    assert files and all(f"/bucket={bucket}/" in name for name in files)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan_of(read))
    assert {row.term for row in read.select("term").distinct().collect()} == {"grid"}
    # All postings of a chunk are in one task: no shuffle before the sum of a chunk, for words and for phrases.
    summed = read.groupBy("document_id", "chunk_index").agg({"tf": "sum"})
    assert "Bucketed: true" in plan_of(summed) and "Exchange hashpartitioning" not in plan_of(summed)
    phrase = spark.createDataFrame([(0, 0, 2, "foo"), (0, 1, 2, "bar")], "unit int, place int, length int, term string")
    assert "Exchange hashpartitioning" not in plan_of(lexical.phrase_postings(index, phrase))


def test_an_index_is_opened_again(spark, built, tmp_path):
    _, _, _, rows, index = built
    lexical.store(rows, str(tmp_path / "index"))
    again = stored.open_index(spark, f"{tmp_path}/index/")
    queries = asked(spark, ["наказ карта", "foo_bar the", "grid"])
    results = [sorted(map(tuple, lexical.search(one, queries, 20).collect())) for one in (index, again, rows)]
    assert results[0] == results[1] == results[2]
    assert again.corpus.first() == lexical.corpus_stats(rows).first()
    counted = sorted(map(tuple, again.terms.select("term", "df").collect()))
    assert counted == sorted(map(tuple, lexical.term_stats(rows).collect()))


def test_text_is_fetched_from_the_folders_of_its_documents(spark, built):
    _, docs, chunks, _, index = built
    texts = stored.store_chunks(chunks, parts=16)
    results = lexical.search(index, asked(spark, ["йод grid"]), 3)
    shown = lexical.with_provenance(results, texts, docs).collect()
    plain = lexical.with_provenance(results, chunks, docs).collect()
    assert sorted(map(tuple, shown)) == sorted(map(tuple, plain)) and len(shown) == results.count()
    wanted = {row.part for row in results.select(texts.part_of("document_id").alias("part")).collect()}
    read = texts.of_parts(results, "document_id")
    names = [row.name for row in read.select(F.input_file_name().alias("name")).distinct().collect()]
    assert {int(name.split("/part=")[1].split("/")[0]) for name in names} == wanted
    assert len(wanted) < 16 and "PartitionFilters: [" in plan_of(read)


def test_queries_with_one_id_are_an_error(spark, built):
    twice = spark.createDataFrame([("q", "pear", [1.0]), ("q", "fig", [2.0])], "query_id string, query string, vector array<double>")
    with pytest.raises(ValueError, match="same query_id"):
        lexical.search(built[4], twice, 2)
    table = spark.createDataFrame([("a", 1, 0, "m", [1.0])], "chunk_id string, document_id long, chunk_index long, model string, embedding array<float>")
    with pytest.raises(ValueError, match="same query_id"):
        vectors.search(table, twice, "m", 2)


def test_passes_give_the_same_ranking(spark, built, monkeypatch):
    index = built[4]
    queries = asked(spark, ["наказ карта", "foo_bar the", "grid", "nothing here", "the"])
    whole = sorted(map(tuple, lexical.search(index, queries, 9).collect()))
    monkeypatch.setattr(lexical, "PASS_LIMIT", 4)
    assert sorted(map(tuple, lexical.search(index, queries, 9).collect())) == whole


def test_a_term_in_every_chunk_lies_in_as_many_files_as_others(spark, built):
    index = built[4]
    files = index.postings.inputFiles()
    per_bucket = {}
    for name in files:
        per_bucket.setdefault(name.split("/bucket=")[1].split("/")[0], set()).add(name)
    most = index.postings.groupBy("term").count().orderBy("count", ascending=False).first()
    [bucket] = index.located(spark.createDataFrame([(most.term,)], "term string"))[1]
    assert most["count"] > 75 and len(per_bucket[str(bucket)]) >= 4


def test_a_pass_gives_the_best_of_each_task_without_a_shuffle(spark, built, monkeypatch):
    index = built[4]
    queries = asked(spark, ["the grid", "foo_bar the", "the наказ карта", "the_the"])
    whole = sorted(map(tuple, lexical.search(index, queries, 4).collect()))
    monkeypatch.setattr(lexical, "CELLS", 7)
    assert sorted(map(tuple, lexical.search(index, queries, 4).collect())) == whole
    scored = lexical._search_pass(index, queries, 4, F.lit(0.0), {}, None)
    assert "Exchange hashpartitioning" not in plan_of(scored)
    per_task = scored.groupBy(F.spark_partition_id(), "query_id").count().collect()
    assert len({row.query_id for row in per_task}) == 4 and max(row["count"] for row in per_task) <= 4


def test_phrases_alone_and_no_words(spark, built):
    index = built[4]
    found = lexical.search(index, asked(spark, ["foo_bar", "- -"]), k=200).collect()
    assert {row.query_id for row in found} == {0} and {row.all_terms for row in found} == {True}
    assert lexical.search(index, asked(spark, ["..."])).count() == 0


def test_runs_of_rows_by_cost():
    cost = np.array([3, 3, 9, 1, 1, 30, 2])
    runs = list(shares(cost, 7))
    assert [at for run in runs for at in range(*run)] == list(range(7))
    assert all(cost[low + 1 : high].sum() < 7 for low, high in runs)
    assert list(shares(cost[:0], 7)) == []
