"""Document metadata from ordered rules over names, folders and the start of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.rules import RulePack, document_date, first_group, first_match
from folioscope.functions.text import normalize
from folioscope.operators.pages import replace_columns

METADATA_COLUMNS = (
    "document_type",
    "content_category",
    "document_number",
    "document_date",
    "organization",
    "metadata_status",
    "metadata_notes",
)


def _joined(*names: str) -> Column:
    return F.concat_ws(" ", *(F.nullif(name, F.lit("")) for name in names))


def _matching(text: Column) -> Column:
    """Normalized text, with the two letters that have another letter's capital written as that letter."""
    return F.translate(normalize(text), "ſı", "si")


def extract_metadata(documents: DataFrame, pack: RulePack = RulePack()) -> DataFrame:
    """``documents`` has id, name, relative_path, folder_category and text_start."""
    texts = documents.select(
        "id",
        _matching(F.col("name")).alias("name_text"),
        _matching(F.concat_ws(" ", "relative_path", "folder_category")).alias("path_text"),
        _joined("name", "relative_path", "folder_category", "text_start").alias("raw"),
    ).withColumn("text", _matching(F.col("raw")))
    matches = texts.select(
        "id",
        F.coalesce(
            first_match(pack.document_types, F.col("name_text"), "name:"),
            first_match(pack.document_types, F.col("path_text"), "path:"),
            first_match(pack.document_types, F.col("text"), "text:"),
        ).alias("document_type"),
        first_match(pack.content_categories, F.col("text")).alias("content_category"),
        first_group(pack.document_numbers, F.col("raw"), F.col("text")).alias("document_number"),
        document_date(F.col("raw")).alias("document_date"),
        first_match(pack.organizations, F.col("text")).alias("organization"),
    )
    fields = METADATA_COLUMNS[:5]
    found = sum((F.col(name).isNotNull().cast("int") for name in fields), F.lit(0))
    notes = [F.concat(F.lit(f"{name}:"), F.col(name)["pattern"]) for name in fields]
    return matches.select(
        "id",
        F.coalesce(F.col("document_type")["value"], F.lit("unknown")).alias("document_type"),
        *(F.col(name)["value"].alias(name) for name in fields[1:]),
        F.when(found == len(fields), "metadata_extracted")
        .when(found > 0, "metadata_partial")
        .otherwise("metadata_empty")
        .alias("metadata_status"),
        F.concat_ws("; ", *notes, F.when(found == 0, "no_rules_matched")).alias("metadata_notes"),
    )


def update_metadata(documents: DataFrame, metadata: DataFrame) -> DataFrame:
    return replace_columns(documents, metadata, METADATA_COLUMNS)
