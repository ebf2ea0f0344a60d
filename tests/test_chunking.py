import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from folioscope.operators import chunking
from folioscope.operators.chunking import ChunkOptions, build_chunks, chunking_counters, point_spans, windows

TEXTS = st.text(alphabet="ab .!?\n1", max_size=400)


def expected_windows(text, target, overlap):
    """Every window tried character by character."""
    spans, start = [], 0
    while start < len(text):
        end = min(start + target, len(text))
        if end < len(text):
            for place in range(end - 1, start + target // 2, -1):
                pair = text[place : min(place + 2, end)]
                if text[place] == "\n" or pair in (". ", "! ", "? "):
                    end = place + 1
                    break
        spans.append((start, end))
        if end == len(text):
            break
        start = end - overlap
    return spans


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(10, 40), st.integers(0, 5))
def test_windows_match_a_character_search(text, target, overlap):
    spans = list(windows(text, target, overlap))
    assert spans == expected_windows(text, target, overlap)
    for (_, end), (start, _) in zip(spans, spans[1:]):
        assert end - start == overlap


def test_window_breaks_around_the_middle():
    assert list(windows("a" * 6 + "\n" + "b" * 8, 10, 2))[0] == (0, 7)
    assert list(windows("a" * 5 + "\n" + "b" * 8, 10, 2))[0] == (0, 10)
    assert list(windows("a" * 7 + ". " + "b" * 8, 10, 2))[0] == (0, 8)
    assert list(windows("a" * 9 + ". " + "b" * 8, 10, 2))[0] == (0, 10)
    assert list(windows("a" * 10, 10, 2)) == [(0, 10)]


def test_options_refuse_windows_that_would_not_advance():
    with pytest.raises(ValueError):
        ChunkOptions(target=100, overlap=51)


def test_two_points_are_cut_by_length():
    text = "1. a\n2. b\n" + "c" * 30
    assert list(point_spans(text, 20, 2)) == list(windows(text, 20, 2))


def test_points_are_joined_up_to_the_target():
    text = "intro\n1. aaaa\n2. bbbb\n\n3. cccc\n"
    assert list(point_spans(text, 100, 2)) == [(0, len(text))]
    spans = list(point_spans(text, 15, 2))
    assert [text[start:end] for start, end in spans] == ["intro\n1. aaaa", "\n2. bbbb", "\n\n3. cccc\n"] or [
        text[start:end] for start, end in spans
    ] == ["intro\n1. aaaa\n", "2. bbbb\n", "\n3. cccc\n"]


def test_large_section_is_cut_on_its_own():
    text = "1. a\n2. " + "b" * 50 + "\n3. c\n4. d\n"
    spans = list(point_spans(text, 20, 4))
    assert spans[0] == (0, 5) and text[spans[-1][0] :] == "3. c\n4. d\n"
    assert all(end - start <= 20 for start, end in spans)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, min_size=3, max_size=8))
def test_point_spans_cover_the_text(lines):
    text = "".join(f"{number}. x{line}\n" for number, line in enumerate(lines, start=1))
    spans = list(point_spans(text, 60, 10))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(later[0] <= earlier[1] for earlier, later in zip(spans, spans[1:]))


def tables(spark, texts, **document):
    docs = spark.createDataFrame(
        [(n, document.get("kind", "list"), document.get("category"), True, False) for n in range(len(texts))],
        "id long, document_type string, content_category string, has_text boolean, ocr_required boolean",
    )
    pages = [
        (n * 100 + number, n, number, text, len(text))
        for n, parts in enumerate(texts)
        for number, text in enumerate(parts, start=1)
    ]
    return docs, spark.createDataFrame(
        pages, "id long, document_id long, page_number int, text string, text_length int"
    )


def test_short_documents(spark):
    docs, pages = tables(spark, [["x" * 49], ["x" * 50], ["x" * 60, "y" * 39], ["x" * 60, "y" * 40], ["z" * 100, "w"]])
    rows = build_chunks(docs, pages).orderBy("document_id", "chunk_index").collect()
    assert [(row.document_id, row.page_number, row.chunk_index) for row in rows] == [
        (1, 1, 0),
        (2, 1, 0),
        (2, 2, 1),
        (4, 1, 0),
    ]
    counters = chunking_counters(docs, pages).first()
    assert (counters.documents_processed, counters.too_short_documents, counters.short_chunks) == (3, 2, 4)


def test_index_runs_over_all_pages_of_a_long_document(spark, monkeypatch):
    chooser = random.Random(3)
    texts = ["k" * chooser.choice([20, 150]) for _ in range(2500)]
    docs, pages = tables(spark, [texts])
    rows = build_chunks(docs, pages).orderBy("page_number").collect()
    long_pages = [number for number, text in enumerate(texts, start=1) if len(text) == 150]
    assert [(row.page_number, row.chunk_index) for row in rows] == [(page, at) for at, page in enumerate(long_pages)]


def test_strategies(spark):
    points = "\n".join(f"{n}. " + "p" * 60 for n in range(1, 5))
    docs, pages = tables(spark, [[points, "second " * 20, "long " * 800]], kind="order")
    rows = build_chunks(docs, pages).orderBy("chunk_index").collect()
    assert rows[0].chunk_strategy == "structure_based_points" and rows[0].source_type == "structure"
    assert rows[1].chunk_strategy == "page_based"
    assert {row.chunk_strategy for row in rows[2:]} == {"split_long_page"}
    docs, pages = tables(spark, [["Таблиця 1, ТАБЛИЦЯ 2 " + "t" * 100], ["plain " * 30]], category="reference")
    assert [row.chunk_strategy for row in build_chunks(docs, pages).orderBy("document_id").collect()] == [
        "table_or_page_based",
        "document_or_page_based",
    ]


def test_chunks_can_be_found_in_their_page(spark):
    text = "Sentence one is here. And another one!\n" * 200
    docs, pages = tables(spark, [[text]])
    rows = build_chunks(docs, pages).collect()
    assert len(rows) > 2
    assert all(text[row.start_char : row.end_char].strip() == row.chunk_text for row in rows)
    assert all(row.chunk_length == len(row.chunk_text) for row in rows)


def test_skip_reasons(spark):
    docs = spark.createDataFrame(
        [(1, True, True), (2, False, None), (3, None, False), (4, False, True), (5, False, True)],
        "id long, ocr_required boolean, has_text boolean",
    )
    pages = spark.createDataFrame([(1,), (4,)], "document_id long")
    rows = {row.id: row.skip_reason for row in chunking.skip_reasons(docs, pages).collect()}
    assert rows == {1: "ocr_required", 2: "no_text", 3: "no_text", 4: None, 5: "no_text"}


def test_a_worker_cuts_few_pages_at_a_time(spark, monkeypatch):
    texts = [None, "", "one. " * 900, "1. a\n2. b\n3. c\n" * 400, "x" * 6000, " ", None, "tail"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)

    def pieces(most):
        monkeypatch.setattr(chunking, "CUT_ROWS", most)
        shown = rows.select("id", chunking.point_pieces(F.col("text")).alias("pieces"))
        # Batches are streamed through the worker: it never holds the pieces of all pages of a batch.
        plan = shown._jdf.queryExecution().executedPlan().toString()
        assert f"], {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan.split("ArrowEvalPython", 1)[1]
        return sorted(map(tuple, shown.collect()))

    assert pieces(3) == pieces(100)
