"""How a retrieved source is shown and linked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import compact, suffix

# Fixed value: length of a preview.
PREVIEW = 220


def display_path(relative_path: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(relative_path, F.lit("")), filename)


def location(path: Column, page_number: Column, chunk_index: Column, start: Column, end: Column) -> Column:
    """The page for a PDF, else the fragment with its characters where they are known."""
    span = F.concat(F.lit("chars "), start.cast("string"), F.lit("-"), end.cast("string"))
    fragment = F.concat_ws(", ", F.concat(F.lit("fragment "), chunk_index.cast("string")), span)
    page = F.concat(F.lit("page "), page_number.cast("string"))
    return F.when((suffix(path) == "pdf") & page_number.isNotNull(), page).otherwise(fragment)


def preview(text: Column) -> Column:
    return compact(text, PREVIEW)


def source_type(path: Column) -> Column:
    return F.coalesce(F.nullif(suffix(path), F.lit("")), F.lit("unknown"))


def view_url(document_id: Column) -> Column:
    return F.concat(F.lit("/documents/"), document_id.cast("string"), F.lit("/view"))


def download_url(document_id: Column) -> Column:
    return F.concat(F.lit("/documents/"), document_id.cast("string"), F.lit("/download"))


def view_href(url: Column, kind: Column, page_number: Column) -> Column:
    paged = (kind == "pdf") & (F.coalesce(page_number, F.lit(0)) != 0)
    return F.when(paged, F.concat(url, F.lit("#page="), page_number.cast("string"))).otherwise(url)
