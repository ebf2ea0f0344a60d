from pyspark.sql import functions as F

from folioscope.operators import answers, context, profile


def flags(spark, rows):
    df = spark.createDataFrame(rows, "answer string, source_count int")
    return answers.with_flags(df).collect()


def test_flags(spark):
    rows = flags(
        spark,
        [("Answer [1]. " + "x" * 80, 2), ("  ", 0), ("y" * 79, 1), ("y" * 80, 1), ("Okay, ХОРОШО", 0), ("[a]", 0)],
    )
    assert rows[0].has_answer and rows[0].has_citations and rows[0].has_sources and not rows[0].too_short_answer
    assert rows[1].empty_answer and not rows[1].has_answer and not rows[1].too_short_answer
    assert rows[2].too_short_answer and not rows[3].too_short_answer
    assert rows[4].contains_thinking and rows[4].wrong_language_suspected
    assert not rows[5].has_citations


def test_no_answer_markers(spark):
    df = spark.createDataFrame([("Інформацію НЕ ЗНАЙДЕНО.",), ("знайдено",)], "a string")
    assert [row[0] for row in df.select(answers.is_no_answer(F.col("a"))).collect()] == [True, False]


def test_model_summary_and_flag_lists(spark):
    good = "x" * 90
    rows = [
        ("q1", "a", good + " [1]", 1, 2.0, 1.0, None),
        ("q2", "a", good + " [2]", 1, 4.0, 3.0, None),
        ("q1", "b", good, 1, 1.0, 1.0, None),
        ("q1", "c", good + " хорошо", 1, 1.0, 1.0, None),
        ("q1", "d", "let me see", 1, 1.0, 1.0, "timeout"),
    ]
    df = spark.createDataFrame(
        rows,
        "query_id string, model string, answer string, source_count int, total_time_seconds double, "
        "llm_time_seconds double, error string",
    )
    flagged = answers.with_flags(df)
    notes = {row.model: (row.notes, row.avg_total_time) for row in answers.model_summary(flagged).collect()}
    assert notes == {
        "a": ("candidate", 3.0),
        "b": ("review", 1.0),
        "c": ("review: language issues", 1.0),
        "d": ("reject: thinking leaks", 1.0),
    }
    compared = answers.compare_models(flagged)
    lists = {(row.query_id, row.model): row.flags for row in compared.collect()}
    assert lists["q1", "a"] == "citations" and lists["q1", "b"] == "none"
    assert lists["q1", "d"] == "thinking leak, too short, error"
    wide = {row.query_id: row for row in answers.compare_wide(compared, ["a", "b"]).collect()}
    assert wide["q2"].a == "citations" and wide["q2"].b is None
    chosen = answers.select_models(df, include=["a", "b"], skip=["b"])
    assert {row.model for row in chosen.collect()} == {"a"}


RESULTS = (
    "query_id long, rank int, document_id long, chunk_id string, filename string, relative_path string, "
    "page_number int, chunk_index long, start_char int, end_char int, document_type string, "
    "content_category string, chunk_text string"
)


def sources(spark):
    rows = [
        (1, 1, 5, "c1", "a.pdf", "d/a.pdf", 3, 0, 0, 9, "order", "reference", " first\n text "),
        (1, 2, 5, "c2", "a.pdf", "d/a.pdf", 4, 1, 0, 9, "order", "reference", "second"),
        (1, 3, 6, "c3", "b.txt", None, 1, 2, 10, 20, "list", None, "x" * 300),
        (1, 4, 7, "c4", "c.txt", "c.txt", 1, 0, None, None, "list", "", "third"),
    ]
    return context.select_sources(spark.createDataFrame(rows, RESULTS), max_sources=3)


def test_one_source_per_document(spark):
    rows = sources(spark).orderBy("citation_id").collect()
    assert [(row.citation_id, row.chunk_id) for row in rows] == [(1, "c1"), (2, "c3"), (3, "c4")]
    assert [row.location for row in rows] == ["page 3", "fragment 2, chars 10-20", "fragment 0"]
    assert rows[0].preview == "first text" and rows[0].view_href == "/documents/5/view#page=3"
    assert rows[1].display_path == "b.txt" and rows[1].view_href == "/documents/6/view"
    assert len(rows[1].preview) == 220 and rows[1].category == "unknown" and rows[2].category == "unknown"
    assert context.select_sources(sources_table(spark), 1).count() == 1


def sources_table(spark):
    return spark.createDataFrame(
        [(1, n, n, f"c{n}", "a", "a", 1, 0, 0, 1, "t", "c", "x") for n in (1, 2)], RESULTS
    )


def test_context_layouts(spark):
    asked = spark.createDataFrame(
        [(1, "Що таке карта"), (2, "Without sources"), (3, "ЯКИЙ НАКАЗ діє")], "query_id long, query string"
    )
    found = sources(spark)
    both = found.unionByName(found.withColumn("query_id", F.lit(3).cast("long")))
    rows = {row.query_id: row for row in context.assemble_context(asked, both).collect()}
    assert rows[1].query_type == "conceptual" and rows[3].query_type == "document_lookup"
    assert rows[1].context.startswith(
        "[1]\nDocument: d/a.pdf\nLocation: page 3\nType: order\nCategory: reference\nPreview: first text\n"
        "Text:\nfirst text\n\n[2]\n"
    )
    assert "Text:" not in rows[3].context and "first text\n[2]\nDocument: b.txt" in rows[3].context
    assert rows[2].context == context.NO_SOURCES and rows[2].source_count == 0
    bench = {row.query_id: row for row in context.assemble_context(asked, both, benchmark=True).collect()}
    assert "Location: page 3\nDocument ID: 5\nType: order" in bench[3].context and "Text:" in bench[3].context
    assert bench[2].context == ""


def test_citations(spark):
    said = spark.createDataFrame([(1, "A [2] b[9][1]"), (2, "none")], "query_id long, answer string")
    found = sources(spark)
    assert sorted(row.citation_id for row in context.used_sources(said, found).collect()) == [1, 2]
    counts = {row.query_id: tuple(row)[1:] for row in context.citation_counts(said, found).collect()}
    assert counts == {1: (3, 2), 2: (0, 0)}
    parts = context.link_citations(said, found).filter("query_id = 1").orderBy("position").collect()
    assert [(row.part, row.resolved) for row in parts] == [
        ("A ", False),
        ("[2]", True),
        (" b", False),
        ("[9]", False),
        ("[1]", True),
    ]
    final = {row.query_id: row.answer for row in context.final_answers(said, found).collect()}
    assert final == {1: "A [2] b[9][1]", 2: context.INSUFFICIENT}


def test_recommendation_ladder(spark):
    cases = [
        ("list", "reference", ["table"], "table_or_page_based"),
        ("order", None, ["1. point"], "structure_based_points"),
        ("law", None, ["РОЗДІЛ перший"], "section_or_page_based"),
        ("list", None, ["x"], "record_or_page_based"),
        ("poster", None, ["x"], "page_based"),
        ("article", None, ["x", "y"], "document_or_page_based"),
        ("article", None, ["x" * 6000] * 3, "split_long_pages"),
        ("article", None, ["x"] * 3, "page_based_with_review"),
        ("article", None, ["x", "y", "table"], "page_based_initial"),
        ("article", None, [], "document_or_page_based"),
        ("order", None, ["1.1.1. deep"], "structure_based_points"),
    ]
    docs = spark.createDataFrame(
        [(n, f"p{n}", kind, category) for n, (kind, category, *_) in enumerate(cases)],
        "id long, relative_path string, document_type string, content_category string",
    )
    pages = spark.createDataFrame(
        [(n, at, text, len(text)) for n, case in enumerate(cases) for at, text in enumerate(case[2], start=1)],
        "document_id long, page_number int, text string, text_length int",
    )
    found = profile.recommend(docs, pages)
    rows = {row.id: row.recommendation for row in found.collect()}
    assert rows == {n: case[3] for n, case in enumerate(cases)}
    shown = profile.recommendation_examples(found, limit=1).collect()
    more = {row.recommendation: (row.relative_path, row.more) for row in shown}
    assert more["structure_based_points"] == ("p1", 1) and more["page_based"] == ("p4", 0)


def test_length_statistics(spark):
    pages = spark.createDataFrame([(1,), (2,), (4,), (10,)], "n int")
    row = profile.length_stats(pages, "n").first()
    assert tuple(row) == (4, 1, 10, 4.2, 3.0)
    assert tuple(profile.length_stats(pages.filter("false"), "n").first()) == (0, 0, 0, 0.0, 0.0)


def test_types_without_pages_are_kept(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, document_type string")
    pages = spark.createDataFrame([(1, 1, 7)], "document_id long, page_number int, text_length int")
    rows = {row.document_type: tuple(row)[1:] for row in profile.length_stats_by_type(docs, pages).collect()}
    assert rows == {"a": (1, 7, 7, 7.0, 7.0), "b": (0, 0, 0, 0.0, 0.0)}
    counts = {row.document_type: row.pages for row in profile.pages_by_type(docs, pages).collect()}
    assert counts == {"a": 1, "b": 0}


def test_page_quality_counts_blank_pages_twice(spark):
    texts = ["", "  ", "x" * 99, "x" * 100, "x" * 5000, "x" * 5001]
    pages = spark.createDataFrame([(text, len(text)) for text in texts], "text string, text_length int")
    assert tuple(profile.page_quality(pages).first()) == (6, 2, 2, 1)


def test_numbers_of_any_length_are_citations(spark):
    said = spark.createDataFrame([(1, f"see [12] or [{'9' * 30}][7]. [x] end"), (2, ""), (3, None), (4, "[1]\n[2]")], "query_id long, answer string")
    parts = context.answer_parts(said).orderBy("query_id", "position").collect()
    assert [row.part for row in parts if row.query_id == 1] == ["see ", "[12]", " or ", f"[{'9' * 30}]", "[7]", ". [x] end"]
    assert [row.citation_id for row in parts if row.query_id == 1] == [None, 12, None, None, 7, None]
    assert [row.part for row in parts if row.query_id != 1] == ["[1]", "\n", "[2]"]
