"""Every operator and stage on nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from folioscope.llm import (
    decontamination,
    jaccard_join,
    license_scan,
    line_dedup,
    pii_crf,
    quality_rules,
    secret_scan,
    source_mixing,
    suffix_dedup,
    template_extraction,
)
from pyspark.sql import functions as F

PROSE = " ".join(f"word{n} of the text" for n in range(60)) + " mail ann.lee@mail.example.com or +1 (212) 555-0100."
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, counts string, block long, host string, "
    "spans string, sketch string"
)
ROWS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \t\n "), (None, PROSE), (None, None), (6, "one"),
    (7, "Licensed under the Apache License, Version 2.0.\ntoken = 'abcdef123'"), (8, "x" * 5000), (9, "a " * 20000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(key, text, None, None if n % 5 == 0 else "s", None, "c", 1, "h", None, None) for n, (key, text) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "word3 of the text word4 of the text word5 of"), (2, None), (None, "one"), (3, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "jaccard": lambda docs, items: jaccard_join.similar_groups(docs),
    "quality": lambda docs, items: quality_rules.judged(docs),
    "pii": lambda docs, items: pii_crf.scan(docs),
    "licenses": lambda docs, items: license_scan.scan(docs),
    "secrets": lambda docs, items: secret_scan.report(docs),
    "suffix": lambda docs, items: suffix_dedup.without_repeats(docs),
    "mix": lambda docs, items: source_mixing.mixed(docs),
    "lines": lambda docs, items: line_dedup.line_report(docs),
    "contamination": lambda docs, items: decontamination.report(docs, items),
    "good": lambda docs, items: quality_rules.good_documents(docs),
    "cleaned": lambda docs, items: line_dedup.without_boilerplate(docs),
    "decontaminated": lambda docs, items: decontamination.decontaminated(docs, items),
    "cut": lambda docs, items: decontamination.decontaminated(docs, items, remove="spans"),
}
FILTERS = {"good", "decontaminated"}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_and_empty_tables_pass(docs, items, name):
    found = OPERATORS[name](docs, items)
    rows = found.collect()
    assert len(rows) == len(ROWS) or name in FILTERS
    assert OPERATORS[name](docs.limit(0), items).count() == 0
    if name in ("good", "cleaned", "decontaminated", "cut"):
        assert found.columns == docs.columns


def test_defined_results(docs, items):
    groups = [(row.doc_id, row.n_shingles, row.component_id) for row in jaccard_join.similar_groups(docs).collect()]
    assert sorted(groups, key=str)[:3] == sorted([(1, groups[0][1], 1), (2, groups[0][1], 1), (2, groups[0][1], 1)], key=str)
    assert (3, 0, 3) in groups and (4, 0, 4) in groups and (6, 1, 6) in groups
    assert [row.component_id for row in jaccard_join.similar_groups(docs).filter("doc_id is null").collect()] == [None, None]
    kept = {row.doc_id for row in decontamination.decontaminated(docs, items).collect()}
    assert kept == {3, 4, 5, 7, 8, 9, None}
    removed = {row.doc_id: row.n_removed for row in suffix_dedup.without_repeats(docs).filter("doc_id is not null").collect()}
    assert removed[1] == removed[2] == len(PROSE) and removed[3] == 0 and removed[8] == 5000 and removed[9] == 40000
    labels = {row.doc_id: (row.labels, row.n_base, row.score) for row in license_scan.scan(docs).collect()}
    assert labels[7] == ("apache", 1, 1.0) and labels[3] == ("", 0, 0.0)
    assert {row.doc_id: row.n_assign for row in secret_scan.report(docs).collect()}[7] == 1


def test_stages_take_such_rows(spark, docs, tmp_path):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "word3 of the text")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for rows in (docs, docs.limit(0)):
        current = rows
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, current, str(tmp_path))
            assert made.count() <= current.count()
            if n < len(corpus_pipeline.STAGES) - 1:
                assert made.columns == docs.columns
                current = made


def test_pages(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><main><h2>A &amp; B</h2><p>one\n two<p>three</main><footer>x</footer>"
    rows = [(1, "http://h.example/1", page), (1, "http://h.example/1", page), (2, None, page), (3, "http://h.example/2", None),
            (None, "no url", ""), (4, "http://i.example/", "<div class='cookie-notice'>no</div><div>plain text here</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {(row.page_id, row.url): (row.text, row.n_chars) for row in template_extraction.extract(pages).collect()}
    assert got[1, "http://h.example/1"] == ("A & B one two three", 19) == got[2, None]
    assert got[3, "http://h.example/2"] == ("", 0) == got[None, "no url"]
    assert got[4, "http://i.example/"][0] == "plain text here"
    assert template_extraction.extract(pages.limit(0)).count() == 0


def test_rare_layouts_are_articles(spark):
    def layout(n: int, start: str, end: str) -> str:
        story = " ".join(f"word{n}x{m}" for m in range(50))
        links = f"<div class='top'><a href='/'>one link {n}</a> <a href='/'>two links {n}</a></div>"
        return f"<html><body>{links}{start}<h1>title{n}</h1><p>{story}</p>{end}</body></html>"

    usual, rare = ("<div class='story'>", "</div>"), ("<section class='text'>", "</section>")
    plain = [(n, f"http://plain.example/{n}", layout(n, *(usual if n % 100 else rare))) for n in range(200)]
    # One page with a main element; and a host where most have one.
    one = [(1000 + n, f"http://one.example/{n}", layout(n, *(usual if n else ("<main>", "</main>")))) for n in range(20)]
    most = [(2000 + n, f"http://most.example/{n}", layout(n, *(usual if n % 4 == 0 else ("<article>", "</article>")))) for n in range(20)]
    pages = spark.createDataFrame(plain + one + most, "page_id long, url string, html string")
    for row in template_extraction.extract(pages).collect():
        n = row.page_id % 1000
        assert row.text.split() == [f"title{n}", *(f"word{n}x{m}" for m in range(50))], row.url


def test_wrapped_notices(spark):
    notice = license_scan.NOTICES["mit"][1].split()
    wrapped = [
        "\n".join(" ".join(notice[n : n + 6]) for n in range(0, len(notice), 6)),
        "\n\n".join(" ".join(notice[n : n + 12]) for n in range(0, len(notice), 12)),
        "\n".join(notice),
        "\n".join("# " + word for word in notice),
    ]
    prose = "A plain line that is no part of it.\n" * 5
    rows = [(n, prose + text + "\n" + prose) for n, text in enumerate(wrapped)]
    # Its halves far apart are no block.
    rows += [(10, " ".join(notice[:16]) + "\n" + "other things are told here\n" * 40 + " ".join(notice[16:])), (11, prose)]
    got = {row.doc_id: (row.labels, row.score) for row in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: ("mit", 1.0) for n in range(4)} | {10: ("", 0.0), 11: ("", 0.0)}
