"""Table schemas and additive schema evolution."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, LONG, INT, FLAG = StringType(), LongType(), IntegerType(), BooleanType()
DATE, TIME, TEXTS, VECTOR = DateType(), TimestampType(), ArrayType(StringType()), ArrayType(FloatType())


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


DOCUMENTS = _schema(
    id=LONG,
    path=TEXT,
    relative_path=TEXT,
    name=TEXT,
    extension=TEXT,
    document_type=TEXT,
    parent_dir=TEXT,
    relative_dir=TEXT,
    size_bytes=LONG,
    modified_at=TIME,
    sha256=TEXT,
    folder_category=TEXT,
    content_category=TEXT,
    is_temp_file=FLAG,
    is_supported=FLAG,
    is_duplicate_candidate=FLAG,
    pages_count=INT,
    has_text=FLAG,
    ocr_required=FLAG,
    scan_status=TEXT,
    scan_root=TEXT,
    scanned_at=TIME,
    document_number=TEXT,
    document_date=DATE,
    organization=TEXT,
    metadata_status=TEXT,
    metadata_notes=TEXT,
)
PAGES = _schema(
    id=LONG,
    document_id=LONG,
    page_number=INT,
    text=TEXT,
    extraction_method=TEXT,
    text_length=INT,
    created_at=TIME,
)
CHUNKS = _schema(
    chunk_id=TEXT,
    document_id=LONG,
    page_id=LONG,
    page_number=INT,
    chunk_index=LONG,
    chunk_text=TEXT,
    chunk_length=INT,
    chunk_strategy=TEXT,
    source_type=TEXT,
    start_char=INT,
    end_char=INT,
    created_at=TIME,
)
EMBEDDINGS = _schema(chunk_id=TEXT, model=TEXT, embedding=VECTOR, dimension=INT, created_at=TIME)
QUERY_SET = _schema(
    query_id=TEXT,
    query=TEXT,
    known_relevant_documents=TEXTS,
    category=TEXT,
    evaluation_mode=TEXT,
    relevance_confidence=TEXT,
    position=LONG,
)

# What an older documents table gets in the columns it lacks.
DOCUMENT_DEFAULTS = {
    "document_type": "unknown",
    "parent_dir": "",
    "relative_dir": "",
    "is_temp_file": False,
    "is_supported": True,
    "is_duplicate_candidate": False,
    "scan_status": "cataloged",
}
DOCUMENT_RENAMES = {"category": "folder_category"}


def conform(
    df: DataFrame,
    schema: StructType,
    defaults: Mapping[str, object] | None = None,
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rename legacy columns, add missing ones with their default and cast to ``schema``. Projection only."""
    defaults = defaults or {}
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    present = set(df.columns)
    return df.select(
        *(
            (F.col(field.name) if field.name in present else F.lit(defaults.get(field.name)))
            .cast(field.dataType)
            .alias(field.name)
            for field in schema.fields
        )
    )


def conform_documents(df: DataFrame) -> DataFrame:
    return conform(df, DOCUMENTS, DOCUMENT_DEFAULTS, DOCUMENT_RENAMES)
