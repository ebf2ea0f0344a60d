"""From ranked chunks to sources, context, and the sources an answer cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import sources as show
from folioscope.functions.text import citation_ids, compact, contains_any
from folioscope.operators.spread import top_k

# How many sources, how much text of each, and texts used when there is nothing to show.
MAX_SOURCES = 5
CONTEXT_CHARS = 1600
NO_SOURCES = "Джерела не знайдено."
INSUFFICIENT = "У наданих документах недостатньо інформації"
LOOKUP_MARKERS = (
    "які документи",
    "який документ",
    "який наказ",
    "що регламентує",
    "регламентують",
    "визначають",
)


def query_type(question: Column) -> Column:
    return F.when(contains_any(question, LOOKUP_MARKERS), "document_lookup").otherwise("conceptual")


def select_sources(results: DataFrame, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Best chunk of every document, numbered from 1 per query. ``results`` carries the provenance columns."""
    best = top_k(results, ["query_id", "document_id"], [F.asc("rank")], 1, "first").drop("first")
    numbered = top_k(best, ["query_id"], [F.asc("rank")], max_sources, "citation_id")
    path = show.display_path(F.col("relative_path"), F.col("filename"))
    text = compact(F.col("chunk_text"), CONTEXT_CHARS)
    sources = numbered.withColumn("display_path", path).withColumn("text", text)
    kind = show.source_type(F.col("display_path"))
    return sources.select(
        "query_id",
        "citation_id",
        "document_id",
        "chunk_id",
        "display_path",
        show.location(
            F.col("display_path"),
            F.col("page_number"),
            F.col("chunk_index"),
            F.col("start_char"),
            F.col("end_char"),
        ).alias("location"),
        show.preview(F.col("text")).alias("preview"),
        "page_number",
        kind.alias("source_type"),
        show.view_url(F.col("document_id")).alias("view_url"),
        show.download_url(F.col("document_id")).alias("download_url"),
        show.view_href(show.view_url(F.col("document_id")), kind, F.col("page_number")).alias("view_href"),
        "document_type",
        F.coalesce(F.nullif("content_category", F.lit("")), F.lit("unknown")).alias("category"),
        "text",
    )


def context_block(with_text: Column, with_id: bool = False) -> Column:
    """Text block of one source. ``with_id`` adds the document id, as benchmark records show it."""
    lines = [
        F.format_string("[%d]", F.col("citation_id")),
        F.concat(F.lit("Document: "), "display_path"),
        F.concat(F.lit("Location: "), "location"),
        *([F.concat(F.lit("Document ID: "), F.col("document_id").cast("string"))] if with_id else []),
        F.concat(F.lit("Type: "), "document_type"),
        F.concat(F.lit("Category: "), "category"),
        F.concat(F.lit("Preview: "), "preview"),
        F.when(with_text, F.concat(F.lit("Text:\n"), "text")),
    ]
    return F.concat_ws("\n", *lines)


def assemble_context(queries: DataFrame, sources: DataFrame, benchmark: bool = False) -> DataFrame:
    """Context per query. Questions for documents get previews line by line, others the text in paragraphs.

    A query has at most as many blocks as sources were selected for it.
    """
    typed = queries.select("query_id", "query", query_type(F.col("query")).alias("query_type"))
    joined = sources.join(typed.select("query_id", "query_type"), "query_id")
    with_text = F.lit(True) if benchmark else F.col("query_type") != "document_lookup"
    blocks = joined.select("query_id", "citation_id", context_block(with_text, benchmark).alias("block"))
    ordered = blocks.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("citation_id", "block"))).alias("blocks")
    )
    texts = F.transform("blocks", lambda item: item["block"])
    lookup = (F.col("query_type") == "document_lookup") & ~F.lit(benchmark)
    context = F.when(lookup, F.array_join(texts, "\n")).otherwise(F.array_join(texts, "\n\n"))
    missing = "" if benchmark else NO_SOURCES
    return typed.join(ordered, "query_id", "left").select(
        "query_id",
        "query",
        "query_type",
        F.coalesce(F.size("blocks"), F.lit(0)).alias("source_count"),
        F.coalesce(context, F.lit(missing)).alias("context"),
    )


def final_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers with the fixed text where there are no sources or the answer is empty."""
    counts = sources.groupBy("query_id").agg(F.count("*").alias("source_count"))
    joined = answers.join(counts, "query_id", "left").withColumn(
        "source_count", F.coalesce("source_count", F.lit(0))
    )
    unknown = (F.col("source_count") == 0) | (F.coalesce("answer", F.lit("")) == "")
    return joined.withColumn("answer", F.when(unknown, INSUFFICIENT).otherwise(F.col("answer")))


def used_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """The retrieved sources that an answer cites."""
    cited = answers.select("query_id", F.explode(citation_ids(F.col("answer"))).alias("citation_id"))
    return sources.join(cited, ["query_id", "citation_id"], "left_semi")


def citation_counts(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per answer: sources retrieved and sources used."""
    found = sources.groupBy("query_id").agg(F.count("*").alias("retrieved_source_count"))
    used = used_sources(answers, sources).groupBy("query_id").agg(F.count("*").alias("used_source_count"))
    joined = answers.select("query_id").join(found, "query_id", "left").join(used, "query_id", "left")
    names = ("retrieved_source_count", "used_source_count")
    return joined.select("query_id", *(F.coalesce(name, F.lit(0)).alias(name) for name in names))


def answer_parts(answers: DataFrame) -> DataFrame:
    """An answer as a row per text or citation part, in order; ``citation_id`` is set on citations."""
    parts = F.regexp_extract_all("answer", F.lit(r"(?s)\[\d+\]|.+?(?=\[\d+\]|\z)"), F.lit(0))
    split = answers.select("query_id", F.posexplode(parts).alias("position", "part"))
    number = F.regexp_extract("part", r"^\[(\d+)\]$", 1)
    return split.filter(F.col("part") != "").withColumn("citation_id", number.try_cast("long"))


def link_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answer parts with the link of their source; a citation without a source stays plain text."""
    links = sources.select("query_id", "citation_id", "view_href", F.col("display_path").alias("title"))
    joined = answer_parts(answers).join(links, ["query_id", "citation_id"], "left")
    order = Window.partitionBy("query_id").orderBy("position")
    return joined.select(
        "query_id",
        F.row_number().over(order).alias("position"),
        "part",
        "citation_id",
        F.col("view_href").isNotNull().alias("resolved"),
        "view_href",
        "title",
    )
