"""Pages to chunks with character offsets."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folioscope.functions.text import strip
from folioscope.operators.profile import length_stats
from folioscope.operators.spread import attach_in_blocks, running

# Document types split at numbered points, and what makes a page structured or a table page.
POINT_TYPES = ("order", "procedure", "instruction", "doctrine")
POINT_PATTERN = r"^(\s*\d+(?:\.\d+){0,2}\.)\s+(?=\S)"
TABLE_PATTERN = r"\bтаблиц[яі]\b|\btable\b"
MIN_POINTS = 3
MIN_TABLES = 2
MIN_SHORT_DOCUMENT = 50
# Pages a Python worker cuts at a time: besides the batch it was given, it holds the pieces of these only.
CUT_ROWS = 256

_BREAK = re.compile(r"\n|[.!?] ")
_POINT = re.compile(POINT_PATTERN, re.MULTILINE)


@dataclass(frozen=True)
class ChunkOptions:
    page_limit: int = 3000
    target: int = 2500
    overlap: int = 300
    min_length: int = 100

    def __post_init__(self) -> None:
        if not 0 <= self.overlap <= self.target // 2:
            raise ValueError("overlap must lie between 0 and half the target size")


def windows(text: str, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``target`` characters, each cut after its last break if that lies in its second half."""
    found = [(mark.end(), mark.start()) for mark in _BREAK.finditer(text)]
    reach = [end for end, _ in found]
    start, size = 0, len(text)
    while start < size:
        end = min(start + target, size)
        if end < size:
            last = bisect_right(reach, end) - 1
            if last >= 0 and found[last][1] > start + target // 2:
                end = found[last][1] + 1
        yield start, end
        if end == size:
            return
        start = end - overlap


def point_spans(text: str, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Sections between numbered points, neighbours joined up to ``target``, larger ones cut into windows."""
    points = [match.start() for match in _POINT.finditer(text)]
    if len(points) < MIN_POINTS:
        yield from windows(text, target, overlap)
        return
    edges = points + [len(text)]
    if text[: points[0]].strip():
        edges = [0] + edges
    open_span = None
    for low, high in zip(edges, edges[1:]):
        too_large = len(text[low:high].strip()) > target
        if open_span and (too_large or high - open_span[0] > target):
            yield open_span
            open_span = None
        if too_large:
            yield from ((low + start, low + end) for start, end in windows(text[low:high], target, overlap))
        else:
            open_span = (open_span[0] if open_span else low, high)
    if open_span:
        yield open_span


PIECES = ArrayType(
    StructType(
        [
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
            StructField("text", StringType()),
        ]
    )
)


def _pieces(text: Column, at_points: Column, options: ChunkOptions) -> Column:
    """Pieces of a page text, cut at its points or by length. NULL texts stay NULL and cost nothing."""
    target, overlap = options.target, options.overlap

    def cut(texts: pa.Array, points: pa.Array) -> pa.Array:
        offsets, starts, ends, parts = [0], [], [], []
        empty = np.zeros(len(texts), dtype=bool)
        for row, (text, by_points) in enumerate(zip(texts.to_pylist(), points.to_pylist())):
            empty[row] = text is None
            split = point_spans if by_points else windows
            for start, end in split(text, target, overlap) if text else ():
                part = text[start:end].strip()
                if part:
                    starts.append(start)
                    ends.append(end)
                    parts.append(part)
            offsets.append(len(parts))
        fields = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(parts, pa.string())]
        return pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()),
            pa.StructArray.from_arrays(fields, ["start", "end", "text"]),
            mask=pa.array(empty),
        )

    @F.arrow_udf(PIECES)
    def split_pages(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, points in batches:
            for at in range(0, len(texts), CUT_ROWS):
                yield cut(texts.slice(at, CUT_ROWS), points.slice(at, CUT_ROWS))

    return split_pages(text, at_points)


def long_text_pieces(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    return _pieces(text, F.lit(False), options)


def point_pieces(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    return _pieces(text, F.lit(True), options)


def explode_pieces(rows: DataFrame, pieces: Column, keys: list[str]) -> DataFrame:
    exploded = rows.select(*keys, F.posexplode(pieces).alias("position", "piece"))
    return exploded.select(
        *keys,
        "position",
        F.col("piece.start").alias("start_char"),
        F.col("piece.end").alias("end_char"),
        F.col("piece.text").alias("chunk_text"),
    )


def skip_reasons(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Why a document gets no chunks, NULL where it is eligible. A missing has_text counts as no text."""
    having = pages.select(F.col("document_id").alias("id")).distinct().withColumn("has_pages", F.lit(True))
    reason = (
        F.when(F.coalesce("ocr_required", F.lit(False)), "ocr_required")
        .when(~F.coalesce("has_text", F.lit(False)), "no_text")
        .when(F.col("has_pages").isNull(), "no_text")
    )
    return documents.join(having, "id", "left").withColumn("skip_reason", reason).drop("has_pages")


def count_points(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?mdU){POINT_PATTERN}"))


def count_tables(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?iU){TABLE_PATTERN}"))


def page_source(text: Column, fits: Column) -> Column:
    """How a page is chunked, by its document's type and category: structure, table_page, page or long_page.

    Points are only counted in documents split at them, tables only in reference documents.
    """
    points = F.when(F.col("document_type").isin(*POINT_TYPES), count_points(text) >= MIN_POINTS)
    tables = F.when(fits & (F.col("content_category") == "reference"), count_tables(text) >= MIN_TABLES)
    return F.when(points, "structure").when(tables, "table_page").when(fits, "page").otherwise("long_page")


def _split_pages(documents: DataFrame, pages: DataFrame, options: ChunkOptions) -> DataFrame:
    """Every page of an eligible document with its pieces and, of its document, how much text there is.

    Pages meet the narrow columns of their documents first, so a page is cut once, in the one way it is chunked. What is
    shuffled is the text of pages whose document is eligible; the windows after it reuse that shuffle.
    """
    eligible = documents.filter(
        ~F.coalesce("ocr_required", F.lit(False)) & F.coalesce("has_text", F.lit(False))
    ).select(
        F.col("id").alias("document_id"),
        F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        "content_category",
    )
    text = F.coalesce("text", F.lit(""))
    read = pages.select(
        F.col("id").alias("page_id"),
        "document_id",
        "page_number",
        text.alias("text"),
        (F.col("text_length") <= options.page_limit).alias("fits"),
    )
    routed = (
        attach_in_blocks(read, eligible, "document_id", "page_number")
        .withColumn("clean", strip(F.col("text")))
        .withColumn("source_type", page_source(F.col("text"), F.coalesce("fits", F.lit(False))))
    )
    source = F.col("source_type")
    cut = F.when((F.length("clean") > 0) & source.isin("structure", "long_page"), F.col("text"))
    whole = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("clean").alias("text"))
    split = routed.select(
        "document_id",
        "page_id",
        "page_number",
        "block",
        "source_type",
        F.length("clean").alias("clean_length"),
        F.coalesce(
            _pieces(cut, source == "structure", options),
            F.when(F.length("clean") > 0, F.array(whole)),
            F.array().cast(PIECES),
        ).alias("pieces"),
    )
    is_long = F.size(F.filter("pieces", lambda piece: F.length(piece["text"]) >= options.min_length))
    return running(
        split,
        "document_id",
        "page_number",
        {"chars": F.col("clean_length"), "all": F.size("pieces"), "long": is_long},
    )


def build_chunks(documents: DataFrame, pages: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunk table. A page is one chunk, or several if it is long or built of numbered points.

    Chunks under the minimum length are dropped and the rest numbered anew, except in a document that is itself
    under it: that one is kept as it is, or left out when it is very short.
    """
    split = _split_pages(documents, pages, options)
    short_document = F.col("chars_total") < options.min_length
    kept = F.when(
        short_document, F.when(F.col("chars_total") >= MIN_SHORT_DOCUMENT, F.col("pieces"))
    ).otherwise(F.filter("pieces", lambda piece: F.length(piece["text"]) >= options.min_length))
    first = F.when(short_document, F.col("all_before")).otherwise(F.col("long_before"))
    chunks = split.withColumn("first", first).select(
        "document_id", "page_id", "page_number", "source_type", "first", F.posexplode(kept).alias("at", "piece")
    )
    index = (F.col("first") + F.col("at")).cast("long")
    text = F.col("piece.text")
    strategy = (
        F.when(F.col("source_type") == "structure", "structure_based_points")
        .when(F.col("source_type") == "table_page", "table_or_page_based")
        .when(F.col("source_type") == "long_page", "split_long_page")
        .when(F.col("page_number") == 1, "document_or_page_based")
        .otherwise("page_based")
    )
    return chunks.select(
        chunk_id(F.col("document_id"), index, text).alias("chunk_id"),
        "document_id",
        "page_id",
        "page_number",
        index.alias("chunk_index"),
        text.alias("chunk_text"),
        F.length(text).alias("chunk_length"),
        strategy.alias("chunk_strategy"),
        "source_type",
        F.col("piece.start").alias("start_char"),
        F.col("piece.end").alias("end_char"),
        F.current_timestamp().alias("created_at"),
    )


def chunk_id(document_id: Column, chunk_index: Column, text: Column) -> Column:
    """Unique by document and position, and different once the text is."""
    return F.concat_ws(
        "-", document_id.cast("string"), chunk_index.cast("string"), F.substring(F.md5(text.cast("binary")), 1, 8)
    )


def chunking_counters(
    documents: DataFrame, pages: DataFrame, options: ChunkOptions = ChunkOptions()
) -> DataFrame:
    """Documents processed and skipped per reason, and chunks dropped as too short.

    A document left without chunks counts as too short, and the chunks it lost as short chunks.
    """
    per_document = (
        _split_pages(documents, pages, options)
        .groupBy("document_id")
        .agg(F.sum("clean_length").alias("chars"), F.sum("all").alias("n_all"), F.sum("long").alias("n_long"))
    )
    tiny = F.col("chars") < options.min_length
    n_kept = F.when(tiny & (F.col("chars") >= MIN_SHORT_DOCUMENT), F.col("n_all")).otherwise(
        F.when(tiny, F.lit(0)).otherwise(F.col("n_long"))
    )
    counted = per_document.select(F.col("document_id").alias("id"), "n_all", n_kept.alias("n_kept"))
    joined = skip_reasons(documents, pages).join(counted, "id", "left")
    eligible = F.col("skip_reason").isNull()
    return joined.agg(
        F.count_if(eligible & (F.col("n_kept") > 0)).alias("documents_processed"),
        F.count_if(F.col("skip_reason") == "ocr_required").alias("ocr_required"),
        F.count_if(F.col("skip_reason") == "no_text").alias("no_text"),
        F.count_if(eligible & (F.col("n_kept") == 0)).alias("too_short_documents"),
        F.coalesce(F.sum(F.when(eligible, F.col("n_all") - F.col("n_kept"))), F.lit(0)).alias("short_chunks"),
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    return length_stats(chunks, "chunk_length")
