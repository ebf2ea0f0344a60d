from pyspark.sql import functions as F

from folioscope.operators import catalog, pages

COLUMNS = "path string, document_type string, sha256 string, scan_root string, scan_status string, content_category string, has_text boolean"


def versions(spark):
    old = spark.createDataFrame(
        [
            (7, "/r/keep", "order", "h1", "/r", "text_extracted", "training", True),
            (8, "/r/changed", "order", "h2", "/r", "text_extracted", "training", True),
            (9, "/r/gone", "order", "h3", "/r", "text_extracted", None, True),
            (10, "/other/gone", "order", "h4", "/other", "text_extracted", None, True),
        ],
        f"id long, {COLUMNS}",
    )
    new = spark.createDataFrame(
        [
            ("/r/keep", "pdf", "h1", "/r", "cataloged", None, None),
            ("/r/changed", "pdf", "h2b", "/r", "cataloged", None, None),
            ("/r/new", "word", "h5", "/r", "cataloged", None, None),
        ],
        COLUMNS,
    )
    return old, new


def test_upsert(spark):
    old, new = versions(spark)
    rows = {row.path: row for row in catalog.upsert(old, new, "/r").collect()}
    assert set(rows) == {"/r/keep", "/r/changed", "/r/new", "/other/gone"}
    keep = rows["/r/keep"]
    assert (keep.id, keep.document_type, keep.content_category, keep.scan_status) == (
        7,
        "pdf",
        "training",
        "text_extracted",
    )
    assert rows["/r/changed"].sha256 == "h2b" and rows["/r/changed"].content_category == "training"
    assert rows["/r/new"].scan_status == "cataloged" and rows["/r/new"].id is not None
    assert rows["/other/gone"].document_type == "order"


def test_upsert_can_reset_changed_files(spark):
    old, new = versions(spark)
    rows = {row.path: row for row in catalog.upsert(old, new, "/r", reset_on_change=True).collect()}
    changed = rows["/r/changed"]
    assert (changed.content_category, changed.has_text, changed.scan_status) == (None, None, "cataloged")
    assert rows["/r/keep"].content_category == "training"


def test_upsert_is_idempotent(spark):
    old, new = versions(spark)
    once = catalog.upsert(old, new, "/r")
    twice = catalog.upsert(once, new, "/r")
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)


def test_vanished_only_below_the_root(spark):
    old, new = versions(spark)
    assert [row.path for row in catalog.vanished(old, new, "/r").collect()] == ["/r/gone"]


def test_find_document_falls_back(spark):
    docs = spark.createDataFrame(
        [(1, "/r/A.PDF", "", "A.PDF", ""), (2, "/r/b", "x/b.txt", "b", ".TXT")],
        "id long, path string, relative_path string, name string, extension string",
    )
    first = catalog.find_document(docs, 1).first()
    assert (first.relative_path, first.extension) == ("A.PDF", "pdf")
    assert catalog.find_document(docs, 2).first().extension == "txt"
    assert catalog.find_document(docs, 3).count() == 0


def test_page_rollup(spark):
    docs = spark.createDataFrame(
        [(1, "pdf"), (2, "txt"), (3, "docx"), (4, "pdf"), (5, "txt"), (6, "pdf")], "id long, extension string"
    )
    rows = spark.createDataFrame(
        [(1, 1, " \n"), (2, 1, " "), (6, 1, ""), (6, 2, "text")], "document_id long, page_number int, text string"
    )
    errors = spark.createDataFrame([(4, "broken"), (5, "broken")], "document_id long, error string")
    rolled = {row.document_id: row for row in pages.page_rollup(docs, rows, errors).collect()}
    shown = {key: (row.pages_count, row.has_text, row.ocr_required, row.scan_status) for key, row in rolled.items()}
    assert shown == {
        1: (1, False, True, "ocr_required"),
        2: (1, False, False, "text_extracted"),
        3: (1, False, False, "text_extracted"),
        4: (None, False, True, "extraction_error: broken"),
        5: (None, False, False, "extraction_error: broken"),
        6: (2, True, False, "text_extracted"),
    }
    counters = pages.extraction_counters(docs, pages.page_rollup(docs, rows, errors)).first()
    assert (counters.documents, counters.pdf_processed, counters.empty_text) == (6, 3, 3)
    assert (counters.ocr_required, counters.errors) == (1, 2)


def test_text_start_joins_pages_in_order(spark):
    rows = [(1, page, letter * 4) for page, letter in ((2, "b"), (1, "a"), (3, "c"))]
    rows += [(2, page, "") for page in range(1, 2000)] + [(2, 2000, "end")]
    df = spark.createDataFrame(rows, "document_id long, page_number int, text string")
    starts = {row.document_id: row.text_start for row in pages.text_start(df, 11).collect()}
    assert starts == {1: "aaaa bbbb c", 2: " " * 11}
    whole = {row.document_id: row.text_start for row in pages.text_start(df, 5000).collect()}
    assert whole == {1: "aaaa bbbb cccc", 2: " " * 1999 + "end"}


def test_rows_without_root_are_kept(spark):
    schema = "id long, path string, sha256 string, scan_root string"
    old = spark.createDataFrame([(1, "/c/a.txt", "a", None), (2, "/c/b.txt", "b", "/c")], schema)
    new = spark.createDataFrame([("/c/d.txt", "d", "/c")], "path string, sha256 string, scan_root string")
    assert {row.path for row in catalog.upsert(old, new, "/c").collect()} == {"/c/a.txt", "/c/d.txt"}


def test_only_the_start_of_a_document_is_shuffled(spark):
    rows = [(document, page, "x" * 40) for document in range(5) for page in range(1, 2001)]
    df = spark.createDataFrame(rows, "document_id long, page_number int, text string").coalesce(1)
    read = df.selectExpr("document_id", "cast(page_number as long) page_number", "text piece", "length(text) page_chars")
    kept = read.mapInArrow(pages._reaching(500), read.schema).groupBy("document_id").count().collect()
    # 13 pages of 41 characters with their space reach into 500.
    assert {row["count"] for row in kept} == {13}
    starts = pages.text_start(df.orderBy(F.desc("page_number")), 500).collect()
    assert {row.text_start for row in starts} == {" ".join(["x" * 40] * 13)[:500]}
