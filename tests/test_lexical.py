import random
import re
import sqlite3

import pytest

from folioscope.operators import lexical

WORDS = ["наказ", "карта", "été", "ete", "Foo_Bar", "foo", "bar", "the", "the", "the", "йод", "it's", "grid", "42"]


def corpus(seed, size):
    chooser = random.Random(seed)
    kinds = ["order", "standard_or_norms", "list"]
    return [
        (
            n,
            " ".join(chooser.choice(WORDS) for _ in range(chooser.randint(1, 30))),
            f"file_{n}.pdf",
            f"dir/file_{n}.pdf",
            chooser.choice(kinds),
            chooser.choice(["reference", "training", None]),
            chooser.choice(["page_based", "split_long_page"]),
        )
        for n in range(size)
    ]


def tables(spark, rows):
    docs = spark.createDataFrame(
        [(n, name, path, "/r/" + path, "/r", kind, category) for n, _, name, path, kind, category, _ in rows],
        "id long, name string, relative_path string, path string, scan_root string, document_type string, "
        "content_category string",
    )
    chunks = spark.createDataFrame(
        [(str(n), n, 0, 1, text, 0, len(text), strategy) for n, text, *_, strategy in rows],
        "chunk_id string, document_id long, chunk_index long, page_number int, chunk_text string, start_char int, "
        "end_char int, chunk_strategy string",
    )
    return docs, chunks


class Fts:
    """The same search in SQLite's own full-text index."""

    def __init__(self, rows):
        self.db = sqlite3.connect(":memory:")
        self.db.execute("CREATE VIRTUAL TABLE f USING fts5(body, a, b, kind, category, strategy, tokenize = 'unicode61')")
        self.db.executemany(
            "INSERT INTO f(rowid, body, a, b, kind, category, strategy) VALUES (?, ?, ?, ?, ?, ?, ?)",
            [(n, text, name, path, kind, category or "", strategy) for n, text, name, path, kind, category, strategy in rows],
        )

    def search(self, query, boost=False, where="1"):
        words = [word for word in dict.fromkeys(re.findall(r"\w+", query.lower())) if len(word) >= 2]
        phrases = ['"' + word + '"' for word in words] or ['"' + query.strip().replace('"', '""') + '"']
        points = (
            "CASE WHEN category = 'reference' AND kind = 'standard_or_norms' THEN 5.0 "
            "WHEN category = 'reference' THEN 1.0 ELSE 0.0 END"
            if boost
            else "0.0"
        )
        for glue in (" AND ", " OR "):
            found = self.db.execute(
                f"SELECT rowid, {points} - bm25(f, 1.0, 4.0, 3.0, 1.5, 2.0, 0.5) AS score FROM f "
                f"WHERE f MATCH ? AND {where}",
                ("body : (" + glue.join(phrases) + ")",),
            ).fetchall()
            if found:
                return dict(found)
        return {}


QUERIES = [
    "наказ карта",
    "ETE",
    "été ete",
    "foo_bar",
    "foo_bar йод",
    "the",
    "the grid 42 missing",
    "nothing here",
    "!?",
    "a",
    "it's",
    "bar foo the йод grid",
    "__ foo",
]


@pytest.mark.parametrize(("seed", "size"), [(1, 60), (2, 7), (3, 200)])
@pytest.mark.parametrize("boost", [False, True])
def test_same_as_sqlite_fts(spark, seed, size, boost):
    rows = corpus(seed, size)
    docs, chunks = tables(spark, rows)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    index = lexical.build_index(chunks, docs)
    found = lexical.search(index, queries, k=size, prefer_reference=boost).collect()
    fts = Fts(rows)
    for number, query in enumerate(QUERIES):
        got = {row.document_id: row.score for row in found if row.query_id == number}
        want = fts.search(query, boost)
        assert got.keys() == want.keys(), query
        assert all(got[key] == pytest.approx(want[key], abs=1e-9) for key in got), query
        ranks = sorted((row.rank, row.document_id) for row in found if row.query_id == number)
        expected = sorted(want, key=lambda key: (-round(want[key], 10), key))
        assert [key for _, key in ranks] == expected, query


def test_filters_come_before_the_choice_of_terms(spark):
    rows = corpus(4, 80)
    docs, chunks = tables(spark, rows)
    queries = spark.createDataFrame([(1, "наказ карта grid йод")], "query_id long, query string")
    index = lexical.build_index(chunks, docs)
    found = lexical.search(
        index, queries, 80, document_type="order", content_category="training", chunk_strategy="page_based"
    ).collect()
    where = "kind = 'order' AND category = 'training' AND strategy = 'page_based'"
    want = Fts(rows).search("наказ карта grid йод", where=where)
    assert {row.document_id: pytest.approx(row.score) for row in found} == want


def test_statistics_and_postings(spark):
    rows = corpus(5, 30)
    docs, chunks = tables(spark, rows)
    index = lexical.build_index(chunks, docs).cache()
    stats = lexical.corpus_stats(index).first()
    assert stats.n_chunks == 30
    postings = lexical.postings(index).collect()
    by_term = {}
    for row in postings:
        assert row.tf == len(row.positions)
        by_term[row.term] = by_term.get(row.term, 0) + 1
    assert by_term == {row.term: row.df for row in lexical.term_stats(index).collect()}
    tokens = {row.document_id: row.tokens for row in index.collect()}
    assert all(tokens[row.document_id][place] == row.term for row in postings for place in row.positions)


def test_provenance(spark):
    docs, chunks = tables(spark, corpus(6, 20))
    queries = spark.createDataFrame([(1, "наказ")], "query_id long, query string")
    results = lexical.search(lexical.build_index(chunks, docs), queries, 5)
    shown = lexical.with_provenance(results, chunks, docs).collect()
    assert len(shown) == results.count()
    assert all(row.filename == f"file_{row.document_id}.pdf" and "наказ" in row.chunk_text for row in shown)


def test_empty_tables(spark):
    docs, chunks = tables(spark, corpus(7, 3))
    none = spark.createDataFrame([], "query_id long, query string")
    index = lexical.build_index(chunks, docs)
    assert lexical.search(index, none).count() == 0
    queries = spark.createDataFrame([(1, "наказ")], "query_id long, query string")
    assert lexical.search(index.filter("false"), queries).count() == 0


def test_stored_statistics_give_the_same_scores(spark):
    docs, chunks = tables(spark, corpus(8, 50))
    index = lexical.build_index(chunks, docs)
    stats = lexical.IndexStats(lexical.term_stats(index), lexical.corpus_stats(index))
    for texts in (["наказ карта", "the grid nowhere"], ["foo_bar the"]):
        queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
        counted = sorted(map(tuple, lexical.search(index, queries, 9).collect()))
        assert sorted(map(tuple, lexical.search(index, queries, 9, stats=stats).collect())) == counted


def test_query_without_text_finds_nothing(spark):
    docs, chunks = tables(spark, corpus(9, 10))
    queries = spark.createDataFrame([(1, None), (2, "наказ")], "query_id long, query string")
    found = lexical.search(lexical.build_index(chunks, docs), queries, 3)
    assert {row.query_id for row in found.collect()} <= {2}
