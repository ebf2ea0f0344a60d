"""Page-level operators: roll-up to documents, replacement, and the start of a document's text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.operators.spread import running
from folioscope.sources.files import DOCUMENT_KINDS
from folioscope.sources.keyed import KeyedTable

TEXT_START = 5000


def supported_documents(documents: DataFrame, document_id: int | None = None) -> DataFrame:
    chosen = documents.filter(
        F.col("extension").isin(*DOCUMENT_KINDS) & F.coalesce("is_supported", F.lit(True))
    )
    return chosen if document_id is None else chosen.filter(F.col("id") == document_id)


def page_rollup(documents: DataFrame, pages: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Extraction columns per document. ``errors`` has document_id and error.

    A document without pages counts as one empty page; a failed one has no page count.
    """
    if errors is None:
        errors = pages.sparkSession.createDataFrame([], "document_id long, error string")
    per_document = pages.groupBy("document_id").agg(
        F.count("*").cast("int").alias("n"),
        F.bool_or(strip(F.coalesce("text", F.lit(""))) != "").alias("any_text"),
    )
    failed = errors.groupBy("document_id").agg(F.min("error").alias("error"))
    joined = (
        documents.select(F.col("id").alias("document_id"), "extension")
        .join(per_document, "document_id", "left")
        .join(failed, "document_id", "left")
    )
    ok = F.col("error").isNull()
    has_text = ok & F.coalesce("any_text", F.lit(False))
    ocr_required = (F.col("extension") == "pdf") & ~has_text
    return joined.select(
        "document_id",
        F.when(ok, F.coalesce("n", F.lit(1))).alias("pages_count"),
        has_text.alias("has_text"),
        ocr_required.alias("ocr_required"),
        F.when(~ok, F.concat(F.lit("extraction_error: "), "error"))
        .when(ocr_required, "ocr_required")
        .otherwise("text_extracted")
        .alias("scan_status"),
    )


def apply_rollup(documents: DataFrame, rollup: DataFrame) -> DataFrame:
    """Documents with the columns of the roll-up replaced; documents that were not processed stay as they are."""
    columns = ("pages_count", "has_text", "ocr_required", "scan_status")
    return replace_columns(documents, rollup.withColumnRenamed("document_id", "id"), columns)


def replace_columns(documents: DataFrame, changes: DataFrame, columns) -> DataFrame:
    """Columns of ``documents`` replaced by id wherever ``changes`` has the id. Both have one row per id."""
    present = set(documents.columns)
    change = changes.select("id", F.struct(*columns).alias("change"))
    joined = documents.join(change, "id", "left")
    hit = F.col("change").isNotNull()

    def replaced(name: str):
        old = F.col(name) if name in present else F.lit(None)
        return F.when(hit, F.col("change")[name]).otherwise(old).alias(name)

    kept = [name for name in documents.columns if name not in columns]
    return joined.select(*kept, *(replaced(name) for name in columns))


def replace_pages(existing: DataFrame, extracted: DataFrame, processed: DataFrame) -> DataFrame:
    """Pages of every processed document give way to the extracted ones. ``processed`` has document_id."""
    done = processed.select("document_id").distinct()
    return existing.join(done, "document_id", "left_anti").unionByName(extracted, allowMissingColumns=True)


def replace_stored_pages(table: KeyedTable, extracted: DataFrame, processed: DataFrame) -> int:
    """``replace_pages`` in a stored table of pages, keyed by document_id: only the folders of processed documents are
    read and rewritten. Returns their number."""
    return table.rewrite(processed, lambda old: replace_pages(old, extracted, processed))


def extraction_counters(documents: DataFrame, rollup: DataFrame) -> DataFrame:
    joined = documents.select(F.col("id").alias("document_id"), "extension").join(rollup, "document_id")
    failed = F.startswith("scan_status", F.lit("extraction_error"))
    return joined.agg(
        F.count("*").alias("documents"),
        *(F.count_if(F.col("extension") == kind).alias(f"{kind}_processed") for kind in DOCUMENT_KINDS),
        F.count_if(~failed & ~F.col("has_text")).alias("empty_text"),
        F.count_if(~failed & F.col("ocr_required")).alias("ocr_required"),
        F.count_if(failed).alias("errors"),
    )


def text_start(pages: DataFrame, limit: int = TEXT_START) -> DataFrame:
    """The first ``limit`` characters of a document, its pages joined by a space in page order.

    Only the pages that reach into the limit are joined, or have the space before them in it, each cut to it; so no
    row grows far beyond the limit. Pages that lie behind it after those read beside them are left out before the
    shuffle, so about ``limit`` characters of a document are moved, however many pages it has.
    """
    read = pages.select(
        "document_id",
        F.col("page_number").cast("long").alias("page_number"),
        F.substring("text", 1, limit).alias("piece"),
        F.length("text").alias("page_chars"),
    )
    kept = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in read.schema)
    pieces = read.mapInArrow(_reaching(limit), kept)
    placed = running(pieces, "document_id", "page_number", {"chars": F.col("page_chars") + 1})
    joined = (
        placed.filter(F.col("chars_before") <= limit)
        .groupBy("document_id")
        .agg(F.expr("listagg(piece, ' ') WITHIN GROUP (ORDER BY page_number)").alias("text"))
    )
    return joined.select("document_id", F.substring("text", 1, limit).alias("text_start"))


def _reaching(limit: int):
    """Drop the pages that do not reach into the first ``limit`` characters, judged by the pages of a batch alone: what
    stands before a page there stands before it in the document."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            document = batch["document_id"].dictionary_encode().indices.fill_null(-1).to_numpy()
            page = batch["page_number"].fill_null(0).to_numpy()
            chars = batch["page_chars"].fill_null(0).to_numpy().astype(np.int64) + 1
            order = np.lexsort((page, document))
            total = np.cumsum(chars[order])
            first = np.flatnonzero(np.diff(document[order], prepend=-2))
            sizes = np.diff(np.append(first, len(order)))
            start = total[first] - chars[order][first]
            before = total - chars[order] - np.repeat(start, sizes)
            left = order[before <= limit]
            yield batch.take(pa.array(np.sort(left)))

    return prune


def with_text_start(documents: DataFrame, pages: DataFrame, limit: int = TEXT_START) -> DataFrame:
    starts = text_start(pages, limit).withColumnRenamed("document_id", "id")
    return documents.join(starts, "id", "left").withColumn(
        "text_start", F.coalesce("text_start", F.lit(""))
    )
