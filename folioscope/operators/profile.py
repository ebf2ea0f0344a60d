"""Corpus profile: length statistics, page quality, structural markers and chunking recommendations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.operators.spread import top_k

SHORT_PAGE = 100
LONG_PAGE = 5000

# Structural markers and their patterns.
MARKERS = {
    "section": r"(?iU)\bрозділ\b",
    "chapter": r"(?iU)\bглава\b",
    "appendix": r"(?iU)\bдодаток\b",
    "point_1": r"(?mdU)^\s*\d+\.\s+\S",
    "point_1_1": r"(?mdU)^\s*\d+\.\d+\.\s+\S",
    "point_1_1_1": r"(?mdU)^\s*\d+\.\d+\.\d+\.\s+\S",
    "table": r"(?iU)\bтаблиц[яі]\b|\btable\b",
}
POINTS = ("point_1", "point_1_1", "point_1_1_1")
SECTIONS = ("section", "chapter", "appendix")


def length_stats(lengths: DataFrame, column: str, by: str | None = None, digits: int = 1) -> DataFrame:
    """Rows, minimum, maximum, mean and exact median of ``column``; zeros for a group without a value.

    Values are first counted per distinct length, so the median sees one row per length and not per page.
    """
    groups = [by] if by else []
    histogram = lengths.groupBy(*groups, F.col(column).alias("length")).agg(
        F.count(column).alias("n"), F.sum(F.col(column).cast("long")).alias("chars")
    )
    return _of_histogram(histogram, by, digits)


def _of_histogram(histogram: DataFrame, by: str | None, digits: int) -> DataFrame:
    groups = [by] if by else []
    stats = histogram.groupBy(*groups).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.min("length"), F.lit(0)).alias("min"),
        F.coalesce(F.max("length"), F.lit(0)).alias("max"),
        F.coalesce(F.bround(F.sum("chars") / F.nullif(F.sum("n"), F.lit(0)), digits), F.lit(0.0)).alias("avg"),
        F.coalesce(
            F.bround(F.percentile("length", 0.5, F.coalesce("n", F.lit(0))), digits), F.lit(0.0)
        ).alias("median"),
    )
    return stats.orderBy(by) if by else stats


def length_stats_by_type(documents: DataFrame, pages: DataFrame, digits: int = 1) -> DataFrame:
    """As ``length_stats`` per document type. Pages are counted per document and length before they meet documents,
    so no document is a heavy key, and each table is read once."""
    counted = pages.groupBy("document_id", F.col("text_length").alias("length")).agg(
        F.count("text_length").alias("n")
    )
    docs = documents.select(F.col("id").alias("document_id"), "document_type")
    histogram = (
        docs.join(counted, "document_id", "left")
        .groupBy("document_type", "length")
        .agg(F.sum("n").alias("n"), F.sum(F.col("length").cast("long") * F.col("n")).alias("chars"))
    )
    return _of_histogram(histogram, "document_type", digits)


def pages_by_type(documents: DataFrame, pages: DataFrame) -> DataFrame:
    counts = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    docs = documents.select(F.col("id").alias("document_id"), "document_type")
    return (
        docs.join(counts, "document_id", "left")
        .groupBy("document_type")
        .agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages"))
        .orderBy("document_type")
    )


def quality_columns(short: int = SHORT_PAGE, long: int = LONG_PAGE) -> Mapping[str, Column]:
    """A page of white space only is both empty and short."""
    length = F.col("text_length")
    return {
        "is_empty": strip(F.col("text")) == "",
        "is_short": (length > 0) & (length < short),
        "is_long": length > long,
    }


def page_quality(pages: DataFrame, short: int = SHORT_PAGE, long: int = LONG_PAGE) -> DataFrame:
    flags = quality_columns(short, long)
    return pages.agg(
        F.count("*").alias("pages"),
        *(F.count_if(flag).alias(name.replace("is_", "") + "_pages") for name, flag in flags.items()),
    )


def documents_without_text(documents: DataFrame, pages: DataFrame) -> DataFrame:
    having = pages.select(F.col("document_id").alias("id")).distinct().withColumn("has_pages", F.lit(True))
    return (
        documents.join(having, "id", "left")
        .filter(~F.coalesce("has_text", F.lit(False)) | F.col("has_pages").isNull())
        .drop("has_pages")
    )


def ocr_candidates(documents: DataFrame) -> DataFrame:
    return documents.filter(F.coalesce("ocr_required", F.lit(False)))


def examples(rows: DataFrame, by: str, order: list[str], columns: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows per group and how many more there are. Groups are cut before they are shuffled."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    first = top_k(
        rows.select(by, *order, *columns), [by], [F.col(name) for name in order], limit, "position", order
    )
    shown = first.join(counts, by).withColumn("more", F.greatest(F.col("n") - limit, F.lit(0)))
    return shown.select(by, "position", *order, *columns, "more")


def quality_examples(
    documents: DataFrame, pages: DataFrame, limit: int = 10, short: int = SHORT_PAGE, long: int = LONG_PAGE
) -> DataFrame:
    flags = quality_columns(short, long)
    kinds = F.array_compact(
        F.array(
            F.when(flags["is_short"], F.lit("very_short_page")), F.when(flags["is_long"], F.lit("very_long_page"))
        )
    )
    listed = pages.select("document_id", "page_number", "text_length", F.explode(kinds).alias("kind"))
    shown = examples(listed, "kind", ["document_id", "page_number"], ["text_length"], limit)
    names = documents.select(F.col("id").alias("document_id"), "relative_path")
    return shown.join(names, "document_id").select(
        "kind",
        "position",
        F.format_string(
            "%s p.%d: %d chars", F.col("relative_path"), F.col("page_number"), F.col("text_length")
        ).alias("line"),
        "more",
    )


def document_markers(pages: DataFrame, markers: Mapping[str, str] = MARKERS) -> DataFrame:
    """Occurrences of every marker per document, with its pages and characters."""
    return pages.groupBy("document_id").agg(
        F.count("*").alias("n_pages"),
        F.avg("text_length").alias("avg_length"),
        *(
            F.sum(F.regexp_count("text", F.lit(pattern)).cast("long")).alias(name)
            for name, pattern in markers.items()
        ),
    )


def marker_counts(pages: DataFrame, markers: Mapping[str, str] = MARKERS) -> DataFrame:
    """Occurrences of every marker and documents that have it; markers that never occur are kept."""
    totals = document_markers(pages, markers).agg(
        *(
            F.struct(
                F.coalesce(F.sum(name), F.lit(0)).alias("occurrences"),
                F.count_if(F.col(name) > 0).alias("documents"),
            ).alias(name)
            for name in markers
        )
    )
    return totals.unpivot([], list(markers), "marker", "counts").select(
        "marker", "counts.occurrences", "counts.documents"
    )


def recommend(documents: DataFrame, pages: DataFrame, markers=MARKERS, long_page: int = LONG_PAGE) -> DataFrame:
    """Chunking recommendation per document; the first condition that holds decides."""
    per_document = document_markers(pages, markers).withColumnRenamed("document_id", "id")
    joined = documents.select("id", "relative_path", "document_type", "content_category").join(
        per_document, "id", "left"
    )
    for name in ("n_pages", "avg_length", *markers):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)))

    def any_of(names) -> Column:
        return F.greatest(*(F.col(name) for name in names)) > 0

    kind = F.col("document_type")
    no_marker = sum((F.col(name) for name in markers), F.lit(0)) == 0
    outcome = (
        F.when((F.col("content_category") == "reference") & (F.col("table") > 0), "table_or_page_based")
        .when(
            kind.isin("order", "procedure", "instruction", "doctrine") & any_of(POINTS),
            "structure_based_points",
        )
        .when(kind.isin("training_manual", "law") & any_of(SECTIONS), "section_or_page_based")
        .when(kind == "list", "record_or_page_based")
        .when(kind.isin("poster", "scheme", "brandbook"), "page_based")
        .when((F.col("n_pages") <= 2) & (F.col("avg_length") <= long_page), "document_or_page_based")
        .when(F.col("avg_length") > long_page, "split_long_pages")
        .when(no_marker, "page_based_with_review")
        .otherwise("page_based_initial")
    )
    return joined.withColumn("recommendation", outcome)


def recommendation_examples(recommended: DataFrame, limit: int = 3) -> DataFrame:
    return examples(recommended, "recommendation", ["id"], ["relative_path"], limit)
