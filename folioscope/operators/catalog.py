"""Catalog statistics, exact duplicates and the catalog upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import human_size
from folioscope.operators.spread import HEAVY_ROWS, attach
from folioscope.session import materialize
from folioscope.sources.keyed import KeyedTable

# Columns a new scan does not overwrite in a known document.
KEPT_COLUMNS = ("id", "content_category", "pages_count", "has_text", "ocr_required", "scan_status")
# Columns that later stages derive from the content of a file.
DERIVED_COLUMNS = (
    "content_category",
    "pages_count",
    "has_text",
    "ocr_required",
    "document_number",
    "document_date",
    "organization",
    "metadata_status",
    "metadata_notes",
)


def count_values(rows: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    value = F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy("value")


def duplicate_groups(documents: DataFrame) -> DataFrame:
    """Groups of files with equal content: files, size of one, bytes that could be freed."""
    groups = documents.groupBy("sha256").agg(
        F.count("*").alias("file_count"), F.min("size_bytes").alias("size_bytes")
    )
    return groups.filter("file_count > 1").withColumn(
        "reclaimable_bytes", F.col("size_bytes") * (F.col("file_count") - 1)
    )


def duplicate_members(documents: DataFrame, key: str = "path") -> DataFrame:
    """Every file that has a copy, with the size of its group. One row per file, so a group may be of any size."""
    return _with_copies(documents, key).filter("file_count > 1")


def flag_duplicates(documents: DataFrame, key: str = "path") -> DataFrame:
    flagged = _with_copies(documents, key)
    flag = F.coalesce(F.col("file_count") > 1, F.lit(False))
    return flagged.withColumn("is_duplicate_candidate", flag).drop("file_count")


def _with_copies(documents: DataFrame, key: str) -> DataFrame:
    groups = duplicate_groups(documents).select("sha256", "file_count")
    heavy = groups.filter(F.col("file_count") > HEAVY_ROWS).select("sha256")
    return attach(documents, groups, "sha256", [key], heavy)


def catalog_summary(documents: DataFrame) -> DataFrame:
    """One row: files, bytes, duplicate groups, files in them, bytes that could be freed."""
    by_content = documents.groupBy("sha256").agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.min("size_bytes").alias("size")
    )
    many = F.col("n") > 1
    summary = by_content.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.count_if(many).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(many, F.col("size") * (F.col("n") - 1))), F.lit(0)).alias("reclaimable_bytes"),
    )
    return summary.withColumn("total_size", human_size(F.col("total_bytes"))).withColumn(
        "reclaimable_size", human_size(F.col("reclaimable_bytes"))
    )


def upsert(
    existing: DataFrame,
    scanned: DataFrame,
    scan_root: str,
    new_id: Column | None = None,
    reset_on_change: bool = False,
) -> DataFrame:
    """Next version of the catalog.

    New paths are inserted, known paths take the scanned columns and keep what later stages wrote, paths that
    vanished below ``scan_root`` are dropped, other roots stay. ``reset_on_change`` clears the derived columns of
    a file whose content changed.
    """
    new_id = F.xxhash64("path") if new_id is None else new_id
    old = existing.select("path", F.struct(*existing.columns).alias("old"))
    new = scanned.withColumn("id", new_id).select("path", F.struct("id", *scanned.columns).alias("new"))
    scanned_columns, stored_columns = set(scanned.columns), set(existing.columns)
    names = [*existing.columns, *(name for name in scanned.columns if name not in stored_columns)]
    known = F.col("old").isNotNull()
    seen = F.col("new").isNotNull()
    changed = known & seen & ~F.col("old.sha256").eqNullSafe(F.col("new.sha256"))

    def merged(name: str) -> Column:
        before = F.col("old")[name] if name in stored_columns else F.lit(None)
        if name in KEPT_COLUMNS or name not in scanned_columns:
            after = F.col("new")[name] if name in scanned_columns or name == "id" else F.lit(None)
            value = F.when(known, before).otherwise(after)
        else:
            value = F.when(seen, F.col("new")[name]).otherwise(before)
        if reset_on_change and name in DERIVED_COLUMNS:
            value = F.when(~changed, value)
        if reset_on_change and name == "scan_status":
            value = F.when(changed, F.col("new")[name]).otherwise(value)
        return value.alias(name)

    joined = old.join(new, "path", "full_outer")
    # A stored row without a root belongs to no scan, so it stays.
    kept = joined.filter(seen | ~F.col("old.scan_root").eqNullSafe(F.lit(scan_root)))
    return kept.select(*(merged(name) for name in names))


def upsert_stored(table: KeyedTable, scanned: DataFrame, scan_root: str, **options) -> int:
    """``upsert`` of a stored catalog (keyed by path): only the folders of paths that are new, gone or whose row changes
    are rewritten. Returns their number."""
    spark = scanned.sparkSession
    existing = table.read(spark)
    following = materialize(upsert(existing, scanned, scan_root, **options).select(*existing.columns), "catalog")

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("path", F.struct(*existing.columns).alias(name))

    compared = keyed(existing, "before").join(keyed(following, "after"), "path", "full_outer")
    changed = materialize(compared.filter(~F.col("before").eqNullSafe(F.col("after"))).select("path"), "changed")
    folders = changed.select(table.part_of().alias("folder")).distinct()
    touched = following.withColumn("folder", table.part_of()).join(F.broadcast(folders), "folder", "left_semi")
    return table.rewrite(changed, lambda old: touched.drop("folder"))


def vanished(existing: DataFrame, scanned: DataFrame, scan_root: str) -> DataFrame:
    return existing.filter(F.col("scan_root") == scan_root).join(scanned, "path", "left_anti")


def orphans(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages or chunks whose document has gone."""
    known = documents.select(F.col("id").alias("document_id"))
    return children.join(known, "document_id", "left_anti")


def find_document(documents: DataFrame, document_id: int) -> DataFrame:
    """One document with the fallbacks used for display."""
    relative = F.coalesce(F.nullif("relative_path", F.lit("")), "name")
    tail = F.regexp_extract(relative, r"\.([^./]+)$", 1)
    extension = F.lower(F.ltrim(F.coalesce(F.nullif("extension", F.lit("")), tail), F.lit(".")))
    return documents.filter(F.col("id") == document_id).select(
        "id", "path", relative.alias("relative_path"), "name", extension.alias("extension")
    )
