from pyspark.sql import functions as F

from folioscope.functions import sources, text


def values(spark, rows, column, name="v"):
    numbered = [(place, row) for place, row in enumerate(rows)]
    df = spark.createDataFrame(numbered, f"place int, {name} string")
    return [row[0] for row in df.orderBy("place").select(column).collect()]


def test_strip_and_collapse_know_unicode_space(spark):
    rows = [" a   b\x1f", "\t\n", "", "plain"]
    assert values(spark, rows, text.strip(F.col("v"))) == [row.strip() for row in rows]
    assert values(spark, rows, text.collapse(F.col("v"))) == ["a b", "", "", "plain"]


def test_normalize(spark):
    rows = ["Наказ_№-5  ПОРЯДОК\n", "A-B__c"]
    assert values(spark, rows, text.normalize(F.col("v"))) == ["наказ № 5 порядок", "a b c"]


def test_compact_cuts_and_strips_the_end(spark):
    rows = ["a" * 10, "a" * 11, "aaaaaa bbbbbb"]
    assert values(spark, rows, text.compact(F.col("v"), 10)) == ["a" * 10, "a" * 7 + "...", "aaaaaa..."]


def test_document_name(spark):
    rows = ["dir/ДОК  1.PDF", "a\\b.txt", "x/y/", "name"]
    assert values(spark, rows, text.document_name(F.col("v"))) == ["док 1.pdf", "a/b.txt", "y", "name"]


def test_query_tokens_keep_first_occurrence_and_drop_single_letters(spark):
    rows = ["Наказ foo_bar a НАКАЗ 12", "! ?", "été ete"]
    expected = [["наказ", "foo_bar", "12"], [], ["été", "ete"]]
    assert values(spark, rows, text.query_tokens(F.col("v"))) == expected


def test_index_tokens_fold_latin_but_not_cyrillic_marks(spark):
    rows = ["Été foo_bar", "йод їжак", "ét", "ộ"]
    expected = [["ete", "foo", "bar"], ["йод", "їжак"], ["et"], ["ộ"]]
    assert values(spark, rows, text.index_tokens(F.col("v"))) == expected


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1280, 1536 * 1024, 5 * 1024**3, 3 * 1024**4, 2000 * 1024**4]
    df = spark.createDataFrame([(place, size) for place, size in enumerate(sizes)], "place int, n long")
    shown = [row[0] for row in df.orderBy("place").select(text.human_size(F.col("n"))).collect()]
    assert shown == ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.5 MiB", "5.0 GiB", "3.0 TiB", "2000.0 TiB"]


def test_strip_reasoning(spark):
    rows = [
        "<THINK>a\nb</think> Answer ",
        "Thinking... so\nmore\n\nAnswer",
        " Thinking... only",
        "thinking... stays",
        "Well. Thinking... stays",
    ]
    expected = ["Answer", "Answer", "", "thinking... stays", "Well. Thinking... stays"]
    assert values(spark, rows, text.strip_reasoning(F.col("v"))) == expected


def test_citation_ids(spark):
    rows = ["x [2] y [1][2]", "[a] []", "[99999999999999999999] [3]"]
    assert values(spark, rows, text.citation_ids(F.col("v"))) == [[2, 1], [], [3]]


def test_suffix_and_source_type(spark):
    rows = ["a/b.PDF", "a.b/c", ".txt", "x.tar.gz"]
    assert values(spark, rows, text.suffix(F.col("v"))) == ["pdf", "", "", "gz"]
    assert values(spark, rows, sources.source_type(F.col("v"))) == ["pdf", "unknown", "unknown", "gz"]


def test_location_is_the_page_only_for_pdf(spark):
    rows = [
        ("a.pdf", 3, 0, 1, 9),
        ("a.pdf", None, 2, 1, 9),
        ("a.txt", 3, 4, 5, 6),
        ("a.txt", 3, 4, None, 6),
    ]
    df = spark.createDataFrame(rows, "p string, n int, i int, s int, e int")
    place = sources.location(F.col("p"), F.col("n"), F.col("i"), F.col("s"), F.col("e"))
    assert [row[0] for row in df.select(place).collect()] == [
        "page 3",
        "fragment 2, chars 1-9",
        "fragment 4, chars 5-6",
        "fragment 4",
    ]


def test_file_safe(spark):
    assert values(spark, ["org/model:1b"], text.file_safe(F.col("v"))) == ["org_model_1b"]
