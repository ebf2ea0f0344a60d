from datetime import date

import pytest
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.operators.metadata import extract_metadata, update_metadata


def extract(spark, rows):
    df = spark.createDataFrame(
        [(number, *row) for number, row in enumerate(rows)],
        "id long, name string, relative_path string, folder_category string, text_start string",
    )
    return extract_metadata(df).orderBy("id").collect()


def test_type_is_taken_from_name_then_path_then_text(spark):
    rows = extract(
        spark,
        [
            ("НАКАЗ_5.pdf", "закон/НАКАЗ_5.pdf", "закон", "доктрина"),
            ("x.pdf", "Закон/x.pdf", "Закон", "доктрина"),
            ("x.pdf", "a/x.pdf", "a", "Військова ДОКТРИНА"),
            ("x.pdf", "a/x.pdf", "a", "nothing"),
        ],
    )
    assert [row.document_type for row in rows] == ["order", "law", "doctrine", "unknown"]
    assert rows[0].metadata_notes.startswith(r"document_type:name:\bнаказ\b")
    assert rows[1].metadata_notes.startswith("document_type:path:")
    assert rows[2].metadata_notes.startswith("document_type:text:")
    assert rows[3].metadata_status == "metadata_empty"
    assert rows[3].metadata_notes == "no_rules_matched"


def test_earlier_rule_wins_over_earlier_place(spark):
    row = extract(spark, [("x", "x", "x", "список і порядок")])[0]
    assert row.document_type == "procedure"


def test_all_fields(spark):
    text = "Наказ Міністерство оборони України від 1.2.49 № 7, топографічна карта"
    row = extract(spark, [("наказ 123.pdf", "наказ 123.pdf", "a", text)])[0]
    assert row.document_type == "order"
    assert row.content_category == "cartography_geodesy"
    assert row.document_number == "123"
    assert row.document_date == date(2049, 2, 1)
    assert row.organization == "Міністерство оборони України"
    assert row.metadata_status == "metadata_extracted"


@pytest.mark.parametrize(
    ("raw", "number"),
    [
        ("наказ мо україни 123 інше", "123"),
        ("5№7 x", "7"),
        (" №7 x", None),
        ("NGA.SIG.0012_2.0.0", "NGA.SIG.0012_2.0.0"),
        ("ПВП 3-(10)5", "ПВП 3-(10)5"),
        ("123-1234567890-12", "123-1234567890-12"),
    ],
)
def test_document_number(spark, raw, number):
    df = spark.createDataFrame([(raw,)], "t string")
    found = df.select(rules.first_group(rules.DOCUMENT_NUMBERS, F.col("t"))).first()[0]
    assert (found.value if found else None) == number


@pytest.mark.parametrize(
    ("raw", "expected", "kind"),
    [
        ("1.2.49", date(2049, 2, 1), "numeric_date"),
        ("1.2.50", date(1950, 2, 1), "numeric_date"),
        ("31.02.2024 and 2024-03-05", date(2024, 3, 5), "iso_like_date"),
        ("2024_3_5", date(2024, 3, 5), "iso_like_date"),
        ("1.2.123", date(123, 2, 1), "numeric_date"),
        ("31.02.2024 then 1.1.2020", None, None),
        ("2024-13-01", None, None),
    ],
)
def test_document_date(spark, raw, expected, kind):
    df = spark.createDataFrame([(raw,)], "t string")
    found = df.select(rules.document_date(F.col("t"))).first()[0]
    assert (found.value if found else None) == expected
    assert (found.pattern if found else None) == kind


def test_fixed_letters_first_gives_the_same_answer(spark):
    texts = ["student workbook", "studentworkbook", "станд", "стандарт", "3d друк", "код", "кодекс", "arcgis", "a | b"]
    df = spark.createDataFrame([(text,) for text in texts], "t string")
    every = [pattern for pack in (rules.DOCUMENT_TYPES, rules.CONTENT_CATEGORIES) for _, pattern in pack]
    for pattern in [*every, r"\|", r"ab?c|x*y|a{2}b"]:
        plain = F.col("t").rlike(rules.ignoring_case(pattern))
        assert df.filter(plain != rules.fits(pattern, F.col("t"))).count() == 0, pattern


def test_update_keeps_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a", "x", "word"), (2, "b", "y", "pdf")], "id long, name string, path string, document_type string"
    )
    found = extract_metadata(
        spark.createDataFrame([(1, "наказ", "наказ", "a", "")], "id long, name string, relative_path string, folder_category string, text_start string")
    )
    rows = {row.id: row for row in update_metadata(docs, found).collect()}
    assert rows[1].document_type == "order" and rows[1].path == "x"
    assert rows[2].document_type == "pdf" and rows[2].metadata_status is None
