"""Catalog scan of a directory tree and text decoding."""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions.text import basename, suffix
from folioscope.session import materialize

# File kinds of the catalog.
DOCUMENT_KINDS = {"pdf": "pdf", "doc": "word", "docx": "word", "txt": "text"}
TEMPORARY_PREFIX = "~$"
FALLBACK_ENCODINGS = ("cp1251", "cp1252")
UNDECODABLE = "no supported encoding fits"

# Bytes and files that one task reads, about.
TASK_BYTES = 256 << 20
TASK_FILES = 10_000
PIECE = 4 << 20
LISTED = "relative string, folder boolean, length long, modificationTime timestamp, error string"


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with its file system, as the cluster resolves it; a plain path where that is the local one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(path).toString().rstrip("/")
    return "/" + full.removeprefix("file:").lstrip("/") if full.startswith("file:") else full


def opened(place: str) -> tuple[fs.FileSystem, str]:
    scheme, found, rest = place.partition("://")
    if not found:
        return fs.LocalFileSystem(), place.rstrip("/")
    authority, _, path = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{authority}/")
    return system, f"{base.rstrip('/')}/{path}"


def _wanted(name: str, extensions: Sequence[str]) -> bool:
    return not name.startswith(TEMPORARY_PREFIX) and name.rpartition(".")[2].lower() in extensions and "." in name


def _listing(place: str, extensions: Sequence[str]):
    """What is directly in each folder: its folders, its files of the given kinds, or the error of listing it. Pipes,
    sockets and links to nothing are no files: opening one may never return."""

    def entries(system: fs.FileSystem, base: str, folder: str) -> list[tuple]:
        try:
            infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
        except Exception as error:
            return [(folder, False, None, None, str(error))]
        rows = []
        for info in infos:
            relative = f"{folder}/{info.base_name}".lstrip("/")
            if info.type == fs.FileType.Directory:
                if isinstance(system, fs.LocalFileSystem) and os.path.islink(info.path):
                    continue
                rows.append((relative, True, None, None, None))
            elif info.type == fs.FileType.File and _wanted(info.base_name, extensions):
                rows.append((relative, False, info.size, info.mtime, None))
        return rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(place)
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
        names = [column.split()[0] for column in LISTED.split(", ")]
        for batch in batches:
            for folder in batch["relative"].to_pylist():
                rows = entries(system, base, folder)
                columns = zip(*rows) if rows else ([] for _ in kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return task


def walk(spark: SparkSession, root: str, extensions: Sequence[str] = tuple(DOCUMENT_KINDS)) -> DataFrame:
    """Every file of the given kinds below ``root``, whatever its name starts with, and folders that cannot be listed,
    with the ``error``. A ``root`` that cannot be listed fails.

    Folders are listed by the tasks, level by level; a level is a written table, so the driver only counts folders.
    Links to folders are not followed, as they may lead in a circle.
    """
    place = qualified(spark, root)
    level = spark.createDataFrame([("",)], "relative string")
    listed: list[DataFrame] = []
    while True:
        rows = materialize(level.mapInArrow(_listing(place, extensions), LISTED), "listing")
        if not listed:
            failed = rows.filter("error IS NOT NULL AND relative = ''").first()
            if failed:
                raise FileNotFoundError(f"{root}: {failed['error']}")
        listed.append(rows)
        level = rows.filter("folder").select("relative")
        folders = level.count()
        if not folders:
            break
        level = level.repartition(min(folders, 4 * spark.sparkContext.defaultParallelism))
    found = reduce(DataFrame.unionAll, listed).filter("NOT folder")
    return found.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "relative")).drop("folder")


def _dealt(listed: DataFrame) -> DataFrame:
    """The listed files in even parts by number and bytes. The rows are narrow, whatever the files are."""
    total = listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    cores = min(total["files"], listed.sparkSession.sparkContext.defaultParallelism)
    parts = max(1, cores, math.ceil(total["files"] / TASK_FILES), math.ceil(total["bytes"] / TASK_BYTES))
    return listed.repartition(parts)


def _read(place: str, value: str, kind: pa.DataType, read: Callable):
    """Each listed file with what ``read`` makes of its stream, or with the error of reading it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(place)
        for batch in batches:
            for row in (batch.slice(at, 1) for at in range(batch.num_rows)):
                made, error = None, row["error"][0].as_py()
                if error is None:
                    try:
                        with system.open_input_stream(f"{base}/{row['relative'][0].as_py()}") as stream:
                            made = read(stream)
                    except Exception as failed:
                        error = str(failed)
                yield pa.RecordBatch.from_arrays(
                    [row["path"], row["length"], row["modificationTime"], pa.array([made], kind), pa.array([error], pa.string())],
                    ["path", "length", "modificationTime", value, "error"],
                )

    return task


def _sha256(stream) -> str:
    digest = hashlib.sha256()
    while piece := stream.read(PIECE):
        digest.update(piece)
    return digest.hexdigest()


def _with(spark: SparkSession, root: str, listed: DataFrame, value: str, kind: pa.DataType, read: Callable) -> DataFrame:
    name = "binary" if kind == pa.binary() else "string"
    schema = f"path string, length long, modificationTime timestamp, {value} {name}, error string"
    return _dealt(listed).mapInArrow(_read(qualified(spark, root), value, kind, read), schema)


def hashed(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """Files that ``walk`` listed with their ``sha256``, or with the ``error`` of reading them."""
    return _with(spark, root, listed, "sha256", pa.string(), _sha256)


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] = tuple(DOCUMENT_KINDS)) -> DataFrame:
    """Every file of the given kinds below ``root`` with its ``content``, or with the ``error`` of reading it."""
    listed = walk(spark, root, extensions)
    return _with(spark, root, listed, "content", pa.binary(), lambda stream: stream.read())


def catalog_columns(files: DataFrame, root: str) -> DataFrame:
    """Catalog row per file. ``files`` has path, length, modificationTime and sha256."""
    root = root.rstrip("/")
    relative = F.substring(F.col("path"), len(root) + 2, 1 << 30)
    parts = F.split(relative, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    extension = suffix(F.col("path"))
    kind = F.coalesce(*(F.when(extension == name, F.lit(value)) for name, value in DOCUMENT_KINDS.items()))
    return files.select(
        "path",
        relative.alias("relative_path"),
        basename(F.col("path")).alias("name"),
        extension.alias("extension"),
        kind.alias("document_type"),
        F.when(F.size(parts) > 1, F.element_at(parts, -2))
        .otherwise(basename(F.lit(root)))
        .alias("parent_dir"),
        F.array_join(folders, "/").alias("relative_dir"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        "sha256",
        F.when(F.size(parts) > 1, parts[0]).otherwise("uncategorized").alias("folder_category"),
        F.lit(None).cast("string").alias("content_category"),
        F.lit(False).alias("is_temp_file"),
        F.lit(True).alias("is_supported"),
        F.lit(None).cast("int").alias("pages_count"),
        F.lit(None).cast("boolean").alias("has_text"),
        F.lit(None).cast("boolean").alias("ocr_required"),
        F.lit("cataloged").alias("scan_status"),
        F.lit(root).alias("scan_root"),
        F.current_timestamp().alias("scanned_at"),
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Catalog rows of the files below ``root`` that can be read. Files are hashed piece by piece."""
    files = hashed(spark, root, walk(spark, root))
    return catalog_columns(files.filter("error IS NULL"), root)


def unreadable(spark: SparkSession, root: str, scanned: DataFrame) -> DataFrame:
    """Files and folders below ``root`` that ``scanned`` lacks, with the error of reading them. Only those are tried
    again; one that can be read by now says so."""
    missing = walk(spark, root).join(scanned.select("path"), "path", "left_anti")
    tried = hashed(spark, root, missing)
    error = F.coalesce("error", F.lit("not in the scan, readable by now"))
    return tried.select("path", "length", "modificationTime", error.alias("error"))


@F.arrow_udf(StringType())
def _decode_fallback(contents: pa.Array) -> pa.Array:
    def decode(content: bytes | None) -> str | None:
        for encoding in FALLBACK_ENCODINGS if content is not None else ():
            try:
                return content.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None

    return pa.array([decode(content.as_py()) for content in contents], pa.string())


def decode_text(content: Column) -> Column:
    """UTF-8 with or without a byte-order mark, else the fallback encodings; NULL when none fits.

    Only bytes that are not UTF-8 travel to Python.
    """
    raw = content.cast("string")
    valid = F.is_valid_utf8(raw)
    legacy = _decode_fallback(F.when(~valid, content))
    text = F.when(valid, F.regexp_replace(raw, r"^\x{FEFF}", "")).otherwise(legacy)
    return F.regexp_replace(text, "\r\n?", "\n")


def text_pages(files: DataFrame) -> DataFrame:
    """One page per text file, with an error instead of text where no encoding fits.

    ``files`` has document_id and content.
    """
    decoded = files.withColumn("text", decode_text(F.col("content")))
    return decoded.select(
        "document_id",
        F.lit(1).alias("page_number"),
        "text",
        F.lit("plain-text").alias("extraction_method"),
        F.length("text").alias("text_length"),
        F.when(F.col("text").isNull(), F.lit(UNDECODABLE)).alias("error"),
        F.current_timestamp().alias("created_at"),
    )
