"""The stage tables of a corpus, derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import index_tokens, strip
from folioscope.operators import lexical, stored
from folioscope.operators.chunking import build_chunks
from folioscope.operators.stored import PartedTable, StoredIndex
from folioscope.operators.vectors import locate
from folioscope.session import materialize, shared_folder
from folioscope.sources.files import opened, qualified

T = TypeVar("T")
ROOT = "/corpus"
MODEL = "m0"
LINES_PER_PAGE = 20
# Ids kept for the pages of one document: more than an int page number can reach.
PAGE_IDS = 1 << 32
EXTENSIONS = ("pdf", "docx", "doc", "txt")
TYPES = ("order", "procedure", "training_manual", "standard_or_norms", "list")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in at least as many parts as there are cores; a table of many files stays as it is read."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def _by_remainder(column, values):
    choices = F.array(*(F.lit(value) for value in values))
    return F.element_at(choices, (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as files of a directory tree."""
    docs = table(spark, sf_dir, "documents")
    extension = _by_remainder(F.col("doc_id"), EXTENSIONS)
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), extension)
    return docs.select(
        F.col("doc_id").alias("document_id"),
        "lang",
        F.concat_ws("/", F.lit(ROOT), "source", name).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    extension = _by_remainder(F.col("doc_id"), EXTENSIONS)
    category = F.when(F.col("doc_id") % 3 == 0, "reference").when(F.col("doc_id") % 3 == 1, "training")
    has_text = strip(F.col("text")) != ""
    ocr = (extension == "pdf") & ~has_text
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), extension)
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", F.lit(ROOT), "source", name).alias("path"),
        F.concat_ws("/", "source", name).alias("relative_path"),
        name.alias("name"),
        extension.alias("extension"),
        _by_remainder(F.col("doc_id"), TYPES).alias("document_type"),
        category.alias("content_category"),
        F.col("source").alias("folder_category"),
        F.lit(ROOT).alias("scan_root"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        has_text.alias("has_text"),
        ocr.alias("ocr_required"),
        F.when(ocr, "ocr_required").otherwise("text_extracted").alias("scan_status"),
    )


def _pages(rows: DataFrame) -> DataFrame:
    return rows.select(
        (F.col("document_id") * PAGE_IDS + F.col("page_number")).alias("id"),
        "document_id",
        "page_number",
        "text",
        F.length("text").alias("text_length"),
    )


def whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document."""
    docs = texts(spark, sf_dir)
    return _pages(docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text"))


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every 20 lines."""
    docs = texts(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    last = ((F.size("lines") - 1) / LINES_PER_PAGE).cast("int")
    pages = F.transform(
        F.sequence(F.lit(0), last),
        lambda page: F.array_join(F.slice("lines", page * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"),
    )
    exploded = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(pages).alias("at", "text"))
    return _pages(exploded.withColumn("page_number", F.col("at") + 1))


def point_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document with its lines as numbered points."""
    docs = texts(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    numbered = F.transform(
        "lines", lambda line, at: F.concat((at + 1).cast("string"), F.lit(". "), line)
    )
    return _pages(
        docs.select(
            F.col("doc_id").alias("document_id"),
            F.lit(1).alias("page_number"),
            F.array_join(numbered, "\n").alias("text"),
        )
    )


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document that names two tables."""
    docs = texts(spark, sf_dir)
    text = F.concat(F.lit("Table 1. "), "text", F.lit(" End of table."))
    return _pages(docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text")))


# Starts of texts on which the default rules fire, each with another mix of type, category, number and organization.
RULED_STARTS = (
    "Наказ Міністерство оборони України 123 від",
    "Закон № 45-XII Верховної Ради України",
    "Військова доктрина, умовні знаки",
    "Інструкція: топографічна карта 5№77",
    "Норми часу NGA.SIG.0012_2.0.0 national geospatial",
    "Навчальний посібник ПВП 3-(10)5 Генеральний штаб",
    "Порядок чергування 123-1234567890-12 ЗСУ",
    "Список Starlink esri",
    "nothing of the kind",
)
YEARS = ("49", "50", "2024", "123")


def ruled_starts(text_starts: DataFrame) -> DataFrame:
    """Documents with ``text_start`` behind a start on which rules fire and two dates, some of which do not exist."""
    number = F.col("id")

    def rest(divisor: int):
        return F.pmod(number, F.lit(divisor)).cast("string")

    year = _by_remainder(number, YEARS)
    first = F.concat(rest(33), F.lit("."), rest(14), F.lit("."), year)
    second = F.concat(F.lit("20"), F.lpad(rest(100), 2, "0"), F.lit("-"), rest(13), F.lit("_"), rest(29))
    start = F.concat_ws(" ", _by_remainder(number, RULED_STARTS), first, second, "text_start")
    return text_starts.withColumn("text_start", start)


# Starts of file names by document: hidden and private files are documents, temporary ones are not.
NAME_STARTS = ("", "_", ".", "~$", "")


def written_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for every document, below a folder for each source. Tasks write the files."""
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    docs = texts(spark, sf_dir)
    name = F.concat(
        _by_remainder(F.col("doc_id"), NAME_STARTS),
        F.col("doc_id").cast("string"),
        F.lit("."),
        _by_remainder(F.col("doc_id"), EXTENSIONS),
    )
    rows = docs.select("source", name.alias("name"), F.col("text").cast("binary").alias("content"))
    place = qualified(spark, root)

    def write(batches):
        system, base = opened(place)
        for batch in batches:
            for source, name, content in zip(*(batch[column].to_pylist() for column in ("source", "name", "content"))):
                system.create_dir(f"{base}/{source}", recursive=True)
                with system.open_output_stream(f"{base}/{source}/{name}") as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["files"])

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root


@dataclass(frozen=True)
class Corpus:
    """``chunks`` is the chunk table in folders by document, ``rows`` the index by chunk, ``index`` its stored postings."""

    documents: DataFrame
    texts: PartedTable
    rows: DataFrame
    index: StoredIndex

    @property
    def chunks(self) -> DataFrame:
        return self.texts.table.drop("part")


# Written tables of this process by session, folder and name.
_STORED: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], T]) -> T:
    """The table ``name`` of a corpus, written at its first use in a session, as a corpus is built once and searched often.

    Changed files are not noticed: use another folder or session for them.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_chunks(documents(spark, sf_dir), whole_pages(spark, sf_dir))


def chunk_table(spark: SparkSession, sf_dir: str) -> PartedTable:
    return once(spark, sf_dir, "chunks", lambda: stored.store_chunks(chunks(spark, sf_dir)))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        rows = lexical.build_index(chunk_table(spark, sf_dir).table, documents(spark, sf_dir))
        return materialize(rows, "index")

    return once(spark, sf_dir, "rows", build)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Chunks and index as stored tables."""
    texts_of, rows = chunk_table(spark, sf_dir), index_rows(spark, sf_dir)
    index = once(spark, sf_dir, "index", lambda: lexical.store(rows))
    return Corpus(documents(spark, sf_dir), texts_of, rows, index)


def embeddings(spark: SparkSession, sf_dir: str, chunk_table: DataFrame) -> DataFrame:
    """The given vectors as embeddings of the first chunk of the document with the same number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    first = chunk_table.filter("chunk_index = 0").select("chunk_id", "document_id")
    return first.join(vectors, "document_id").select("chunk_id", F.lit(MODEL).alias("model"), "embedding")


def located_embeddings(spark: SparkSession, sf_dir: str, chunk_table: DataFrame) -> DataFrame:
    return locate(embeddings(spark, sf_dir, chunk_table), chunk_table, documents(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as queries, with the vector of the same number."""
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
    )
    return items.join(vectors, "item_id", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), "vector"
    )


def phrase_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages with their first two words joined by an underscore, which the index takes as a phrase."""
    joined = F.regexp_replace("query", r"^([\p{L}\p{N}]+) ([\p{L}\p{N}]+)", "$1_$2")
    return queries(spark, sf_dir).select("query_id", joined.alias("query"))


def relevant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a passage and a document that contains it.

    A passage is looked up by its longest inner word, which every text that contains the passage has too; only texts
    with that word are compared.
    """
    docs = texts(spark, sf_dir).select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    words = index_tokens(F.col("passage"))
    inner = F.slice(words, 2, F.size(words) - 2)
    longest = F.array_max(F.transform(inner, lambda word: F.struct(F.length(word), word.alias("word"))))["word"]
    checked = F.when(F.size(words) < 3, F.raise_error(F.lit("a passage needs an inner word"))).otherwise(longest)
    keyed = items.select("item_id", "passage", checked.alias("word"))
    found = docs.select("doc_id", F.explode(F.array_distinct(index_tokens(F.col("text")))).alias("word"))
    pairs = found.join(keyed, "word").join(docs, "doc_id").filter(F.contains("text", "passage"))
    return pairs.select("item_id", "doc_id")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with the names of the documents that contain them; passages without one are no test queries."""
    pairs = relevant_documents(spark, sf_dir)
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), _by_remainder(F.col("doc_id"), EXTENSIONS))
    known = pairs.groupBy("item_id").agg(F.array_sort(F.collect_list(name)).alias("known_relevant_documents"))
    items = table(spark, sf_dir, "benchmark")
    return items.join(known, "item_id").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), "known_relevant_documents"
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant turns as answers of three models; every third one cites a source."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    cited = F.concat(F.col("text"), F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("]"))
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, cited).otherwise(F.col("text")).alias("answer"),
        (F.col("turn") % 4).alias("source_count"),
        (F.length("text") / 64.0).cast("double").alias("total_time_seconds"),
        (F.length("text") / 128.0).cast("double").alias("llm_time_seconds"),
    )
