"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import (
    answers,
    catalog,
    chunking,
    context,
    evaluation,
    hybrid,
    lexical,
    metadata,
    pages,
    profile,
    vectors,
)
from folioscope.plans import fixtures as fx
from folioscope.plans.packs import PROFILE_MARKERS, SAMPLE_MARKERS, SAMPLE_PACK
from folioscope.schemas import conform_documents
from folioscope.session import materialize, shared_folder, ship_package
from folioscope.sources import files, keyed, tables
from folioscope.sources.files import catalog_columns, decode_text
from folioscope.sources.tables import query_set

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Catalog


@register
def catalog_projection(spark, d):
    return catalog_columns(fx.files(spark, d), fx.ROOT).select(
        "path",
        "relative_path",
        "name",
        "extension",
        "document_type",
        "parent_dir",
        "relative_dir",
        "size_bytes",
        "sha256",
        "folder_category",
        "scan_status",
        "scan_root",
    )


@register
def dup_groups(spark, d):
    return catalog.duplicate_groups(fx.documents(spark, d))


@register
def dup_members(spark, d):
    docs = fx.documents(spark, d).select("path", "sha256", "size_bytes")
    return catalog.duplicate_members(docs).select("path", "sha256", "file_count")


@register
def dup_flags(spark, d):
    docs = fx.documents(spark, d).select("path", "sha256", "size_bytes")
    return catalog.flag_duplicates(docs).select("path", "is_duplicate_candidate")


@register
def dup_summary(spark, d):
    return catalog.catalog_summary(fx.documents(spark, d))


def _count(name: str, column: str) -> None:
    def count(spark, d):
        return catalog.count_values(fx.documents(spark, d), column)

    count.__name__ = name
    register(count)


_count("count_by_extension", "extension")
_count("count_by_folder", "folder_category")
_count("count_by_category", "content_category")
_count("count_by_type", "document_type")


@register
def count_by_lang(spark, d):
    return catalog.count_values(fx.table(spark, d, "documents"), "lang")


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """A stored catalog of the labelled documents and a scan that finds those with an embedding."""
    stored = fx.table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    seen = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id")).distinct()
    langs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    root = F.when(F.col("lang") == "en", "/archive").otherwise(F.col("scan_root"))
    old = fx.documents(spark, d).join(stored, "id", "left_semi").join(langs, "id").withColumn("scan_root", root)
    found = fx.files(spark, d).join(seen, "document_id", "left_semi")
    new = catalog_columns(found, fx.ROOT)
    return old.drop("lang"), new


@register
def catalog_upsert(spark, d):
    old, new = _versions(spark, d)
    number = F.regexp_extract("name", r"^(\d+)", 1).cast("long")
    stored = keyed.store(old, _folder(spark, "catalog"), "path")
    catalog.upsert_stored(stored, new, fx.ROOT, new_id=number)
    return stored.read(spark).select(
        "id", "path", "document_type", "content_category", "scan_status", "scan_root", "has_text"
    )


@register
def vanished_documents(spark, d):
    old, new = _versions(spark, d)
    return catalog.vanished(old, new, fx.ROOT).select("id", "path")


@register
def orphan_pages(spark, d):
    known = fx.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return catalog.orphans(fx.line_pages(spark, d), known).select("id", "document_id")


@register
def schema_conform(spark, d):
    legacy = fx.documents(spark, d).select("id", "path", "name", F.col("folder_category").alias("category"))
    return conform_documents(legacy).select(
        "id",
        "path",
        "name",
        "document_type",
        "folder_category",
        "is_temp_file",
        "is_supported",
        "scan_status",
        "has_text",
        "organization",
    )


@register
def text_decoding(spark, d):
    """Texts as bytes: single bytes per letter, with a byte-order mark and other line ends, or plain."""
    docs = fx.table(spark, d, "documents")
    windows = F.concat(F.lit("\ufeff"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))
    content = (
        F.when(F.col("lang").isin("fr", "es"), F.encode("text", "iso-8859-1"))
        .when(F.col("lang") == "de", F.encode(windows, "utf-8"))
        .otherwise(F.encode(F.replace("text", F.lit("\n"), F.lit("\r")), "utf-8"))
    )
    return docs.select("doc_id", decode_text(content).alias("text"))


@register
def supported_documents(spark, d):
    docs = fx.documents(spark, d).withColumn("is_supported", F.lit(None).cast("boolean"))
    return pages.supported_documents(docs).select("id", "path")


@register
def scan_folder(spark, d):
    """The documents written as files and found again."""
    root = fx.written_files(spark, d)
    return files.scan(spark, root).select("relative_path", "name", "extension", "size_bytes", "sha256", "folder_category")


@register
def document_record(spark, d):
    last = fx.table(spark, d, "labels").agg(F.max("doc_id")).first()[0]
    nameless = fx.documents(spark, d).withColumns({"relative_path": F.lit(""), "extension": F.lit(None).cast("string")})
    return catalog.find_document(nameless, last)


@register
def stored_documents(spark, d):
    """Documents as an older version wrote them: no types, another name for the folder."""
    path = _folder(spark, "documents")
    kind = F.when(F.col("id") % 2 == 0, F.col("document_type"))
    legacy = fx.documents(spark, d).select("id", "path", kind.alias("document_type"), F.col("folder_category").alias("category"))
    tables.overwrite(legacy, path)
    read = tables.read_documents(spark, path)
    return read.select("id", "path", "document_type", "folder_category", "is_supported")


@register
def stored_pages(spark, d):
    path = _folder(spark, "pages")
    tables.overwrite(fx.line_pages(spark, d), path)
    return tables.read_pages(spark, path).select("id", "document_id", "page_number", "text_length")


@register
def overwritten_chunks(spark, d):
    """The chunk table written anew from one that is there."""
    path = _folder(spark, "chunks")
    tables.overwrite(fx.chunk_table(spark, d).table.select(*CHUNK_COLUMNS), path)
    kept = spark.read.parquet(path).filter("chunk_length >= 200")
    tables.overwrite(kept, path)
    return spark.read.parquet(path).select("chunk_id", "document_id", "chunk_index", "chunk_length")


@register
def json_lines(spark, d):
    path = _folder(spark, "answers")
    tables.write_json_lines(fx.answers(spark, d), path)
    schema = "query_id string, model string, answer string, source_count long, total_time_seconds double"
    return spark.read.schema(schema).json(path)


# Pages


def _rollup(spark, d) -> tuple[DataFrame, DataFrame]:
    """Roll-up with the documents labelled toxic taken as failed."""
    failed = fx.table(spark, d, "labels").filter("toxic = 1")
    errors = failed.select(F.col("doc_id").alias("document_id"), F.lit("unreadable").alias("error"))
    docs = fx.documents(spark, d)
    return docs, pages.page_rollup(docs, fx.line_pages(spark, d), errors)


@register
def page_rollup(spark, d):
    return _rollup(spark, d)[1]


@register
def extraction_counters(spark, d):
    return pages.extraction_counters(*_rollup(spark, d))


@register
def page_status_update(spark, d):
    return pages.apply_rollup(*_rollup(spark, d)).select(
        "id", "path", "pages_count", "has_text", "ocr_required", "scan_status"
    )


@register
def replace_pages(spark, d):
    processed = fx.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    new = fx.whole_pages(spark, d).join(processed, "document_id", "left_semi")
    stored = keyed.store(fx.line_pages(spark, d), _folder(spark, "pages"), "document_id")
    pages.replace_stored_pages(stored, new, processed)
    return stored.read(spark).select("document_id", "page_number", "text_length")


@register
def page_concat_prefix(spark, d):
    return pages.text_start(fx.line_pages(spark, d))


# Profile


@register
def length_stats(spark, d):
    return profile.length_stats(fx.line_pages(spark, d), "text_length", digits=4)


@register
def page_stats_by_lang(spark, d):
    return profile.length_stats(fx.table(spark, d, "documents"), "n_chars", "lang", digits=4)


@register
def length_stats_by_type(spark, d):
    return profile.length_stats_by_type(fx.documents(spark, d), fx.line_pages(spark, d), digits=4)


@register
def pages_by_type(spark, d):
    return profile.pages_by_type(fx.documents(spark, d), fx.line_pages(spark, d))


@register
def page_quality(spark, d):
    return profile.page_quality(fx.line_pages(spark, d))


@register
def quality_examples(spark, d):
    return profile.quality_examples(fx.documents(spark, d), fx.line_pages(spark, d))


@register
def documents_without_text(spark, d):
    labelled = fx.table(spark, d, "labels").select("doc_id")
    labelled_pages = fx.whole_pages(spark, d).join(
        labelled, F.col("document_id") == F.col("doc_id"), "left_semi"
    )
    return profile.documents_without_text(fx.documents(spark, d), labelled_pages).select("id", "relative_path")


@register
def ocr_candidates(spark, d):
    docs = pages.apply_rollup(*_rollup(spark, d))
    return profile.ocr_candidates(docs).select(F.col("id").alias("document_id"), "scan_status")


@register
def document_markers(spark, d):
    return profile.document_markers(fx.point_pages(spark, d), PROFILE_MARKERS)


@register
def marker_counts(spark, d):
    return profile.marker_counts(fx.point_pages(spark, d))


def _recommended(spark, d):
    return profile.recommend(fx.documents(spark, d), fx.point_pages(spark, d), PROFILE_MARKERS)


@register
def recommendation(spark, d):
    return _recommended(spark, d).select("id", "recommendation")


@register
def recommendation_counts(spark, d):
    return catalog.count_values(_recommended(spark, d), "recommendation")


@register
def recommendation_examples(spark, d):
    return profile.recommendation_examples(_recommended(spark, d))


# Metadata


def _metadata(spark, d, *pack) -> DataFrame:
    docs = pages.with_text_start(fx.documents(spark, d), fx.line_pages(spark, d))
    return metadata.extract_metadata(docs, *pack)


@register
def metadata_rules(spark, d):
    return _metadata(spark, d)


@register
def metadata_sample_rules(spark, d):
    return _metadata(spark, d, SAMPLE_PACK)


@register
def metadata_update(spark, d):
    updated = metadata.update_metadata(fx.documents(spark, d), _metadata(spark, d, SAMPLE_PACK))
    return updated.select("id", "path", *metadata.METADATA_COLUMNS)


@register
def metadata_status_counts(spark, d):
    return catalog.count_values(_metadata(spark, d, SAMPLE_PACK), "metadata_status")


@register
def text_functions(spark, d):
    docs = fx.table(spark, d, "documents")
    text = F.col("text")
    file_name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    thought = F.concat(F.lit("<think>"), text, F.lit("</THINK>Thinking... "), text, F.lit("\n\n"), text)
    return docs.select(
        "doc_id",
        tx.normalize(text).alias("normalized"),
        tx.compact(text, 700).alias("compacted"),
        tx.document_name(file_name).alias("document_name"),
        F.array_join(tx.query_tokens(text), " ").alias("query_tokens"),
        tx.human_size(F.col("n_chars") * 977).alias("size_text"),
        tx.file_safe(F.concat(F.col("source"), F.lit(":"), F.col("lang"), F.lit("/x"))).alias("safe_name"),
        tx.strip_reasoning(thought).alias("without_reasoning"),
    )


@register
def metadata_default_rules(spark, d):
    """The default rules and dates over texts on which they fire."""
    docs = pages.with_text_start(fx.documents(spark, d), fx.line_pages(spark, d))
    return metadata.extract_metadata(fx.ruled_starts(docs))


# Chunks


CHUNK_COLUMNS = (
    "chunk_id",
    "document_id",
    "page_id",
    "page_number",
    "chunk_index",
    "chunk_text",
    "chunk_length",
    "chunk_strategy",
    "source_type",
    "start_char",
    "end_char",
)


@register
def chunks_long(spark, d):
    rows = fx.whole_pages(spark, d).withColumnRenamed("id", "page_id")
    pieces = chunking.long_text_pieces(F.col("text"))
    return chunking.explode_pieces(rows, pieces, ["page_id"]).drop("position")


@register
def chunks_all(spark, d):
    return fx.chunks(spark, d).select(*CHUNK_COLUMNS)


@register
def chunks_points(spark, d):
    return chunking.build_chunks(fx.documents(spark, d), fx.point_pages(spark, d)).select(*CHUNK_COLUMNS)


@register
def chunks_pages(spark, d):
    return chunking.build_chunks(fx.documents(spark, d), fx.line_pages(spark, d)).select(*CHUNK_COLUMNS)


@register
def chunks_tables(spark, d):
    return chunking.build_chunks(fx.documents(spark, d), fx.table_pages(spark, d)).select(*CHUNK_COLUMNS)


@register
def chunk_length_stats(spark, d):
    return profile.length_stats(fx.chunks(spark, d), "chunk_length", digits=4)


@register
def chunks_by_strategy(spark, d):
    chunks = chunking.build_chunks(fx.documents(spark, d), fx.point_pages(spark, d))
    return catalog.count_values(chunks, "chunk_strategy")


@register
def chunk_eligibility(spark, d):
    labels = fx.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"),
        (F.col("toxic") == 1).alias("ocr_required"),
        (F.col("quality") == 1).alias("has_text"),
    )
    docs = fx.documents(spark, d).select("id").join(labels, "id", "left")
    embedded = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"))
    paged = fx.whole_pages(spark, d).join(embedded, "document_id", "left_semi")
    return chunking.skip_reasons(docs, paged).select("id", "skip_reason")


@register
def chunking_counters(spark, d):
    return chunking.chunking_counters(fx.documents(spark, d), fx.line_pages(spark, d))


# Full-text search

RESULT_COLUMNS = ("query_id", "rank", "score", "chunk_id", "document_id", "chunk_index", "all_terms")


def _ranked(results: DataFrame) -> DataFrame:
    return results.withColumn("score", F.round("score", 6)).select(*RESULT_COLUMNS)


@register
def index_rows(spark, d):
    return fx.index_rows(spark, d).select(
        "chunk_id",
        "document_type",
        "content_category",
        "chunk_strategy",
        F.size("tokens").alias("n_tokens"),
        "doc_len",
    )


@register
def postings(spark, d):
    found = lexical.postings(fx.index_rows(spark, d))
    places = F.array_join(F.transform("positions", lambda place: place.cast("string")), " ")
    return found.select("term", "chunk_id", "tf", places.alias("positions"))


@register
def term_stats(spark, d):
    return lexical.term_stats(fx.index_rows(spark, d))


@register
def corpus_stats(spark, d):
    stats = lexical.corpus_stats(fx.index_rows(spark, d))
    return stats.withColumn("avg_len", F.round("avg_len", 6))


@register
def query_units(spark, d):
    units = lexical.query_units(fx.phrase_queries(spark, d))
    return units.withColumn("words", F.array_join("words", " "))


@register
def bm25_topk(spark, d):
    return _ranked(lexical.search(fx.corpus(spark, d).index, fx.queries(spark, d)))


@register
def bm25_filtered(spark, d):
    return _ranked(
        lexical.search(
            fx.corpus(spark, d).index,
            fx.queries(spark, d),
            document_type="procedure",
            content_category="training",
            chunk_strategy="split_long_page",
        )
    )


@register
def bm25_boosted(spark, d):
    return _ranked(lexical.search(fx.corpus(spark, d).index, fx.queries(spark, d), prefer_reference=True))


@register
def bm25_phrases(spark, d):
    return _ranked(lexical.search(fx.corpus(spark, d).index, fx.phrase_queries(spark, d)))


@register
def bm25_provenance(spark, d):
    corpus = fx.corpus(spark, d)
    results = lexical.search(corpus.index, fx.queries(spark, d))
    shown = lexical.with_provenance(results, corpus.texts, corpus.documents)
    return shown.select(
        "query_id",
        "rank",
        *(name for name in lexical.PROVENANCE if name != "chunk_text"),
        tx.compact(F.col("chunk_text"), 700).alias("shown"),
    )


# Vectors


def _semantic(spark, d, k: int = 10) -> DataFrame:
    located = fx.located_embeddings(spark, d, fx.chunk_table(spark, d).table)
    found = vectors.search(located, fx.queries(spark, d).filter("vector IS NOT NULL"), fx.MODEL, k)
    return found.withColumn("similarity", F.round("similarity", 5))


@register
def semantic_topk(spark, d):
    return _semantic(spark, d)


@register
def semantic_provenance(spark, d):
    shown = lexical.with_provenance(_semantic(spark, d), fx.chunk_table(spark, d), fx.documents(spark, d))
    return shown.select(
        "query_id",
        "rank",
        "similarity",
        "filename",
        "relative_path",
        "page_number",
        "chunk_index",
        "start_char",
        "end_char",
        "chunk_strategy",
    )


@register
def cosine_expression(spark, d):
    vecs = fx.table(spark, d, "embeddings")
    centers = vecs.select(F.col("vec_id").cast("int").alias("label"), F.col("embedding").alias("center"))
    joined = vecs.join(centers, "label")
    return joined.select("vec_id", F.round(vectors.cosine("embedding", "center"), 5).alias("similarity"))


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    chunks = fx.chunk_table(spark, d).table.drop("part")
    return chunks, fx.embeddings(spark, d, chunks)


@register
def missing_embeddings(spark, d):
    return vectors.missing_embeddings(*_stored(spark, d), fx.MODEL).drop("chunk_text")


@register
def missing_embeddings_first(spark, d):
    return vectors.missing_embeddings(*_stored(spark, d), fx.MODEL, limit=25).drop("chunk_text")


@register
def embedding_coverage(spark, d):
    return vectors.coverage(*_stored(spark, d))


LETTERS = "aeinrst"


def letter_counts(texts: Sequence[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often each of seven letters occurs."""
    return [[float(text.count(letter)) for letter in LETTERS] for text in texts]


def _backfilled(spark, d) -> tuple[DataFrame, DataFrame]:
    chunks, stored = _stored(spark, d)
    return stored, vectors.backfill(chunks, stored, fx.MODEL, letter_counts)


@register
def embedding_backfill(spark, d):
    made = _backfilled(spark, d)[1]
    shown = F.array_join(F.transform("embedding", lambda value: value.cast("long").cast("string")), " ")
    return made.select("chunk_id", "model", "dimension", shown.alias("vector"))


@register
def embedding_upsert(spark, d):
    existing, made = _backfilled(spark, d)
    stored = vectors.store_embeddings(existing, _folder(spark, "embeddings"))
    vectors.upsert_stored(stored, materialize(made, "made").select("chunk_id", "model", "embedding"))
    return stored.read(spark).select("chunk_id", "model", F.size("embedding").alias("dimension"))


# Fusion, evaluation, context


def _hybrid(spark, d, **options) -> tuple[fx.Corpus, hybrid.Rankings]:
    corpus = fx.corpus(spark, d)
    located = fx.located_embeddings(spark, d, corpus.chunks)
    return corpus, hybrid.search(corpus.index, located, fx.queries(spark, d), fx.MODEL, **options)


@register
def hybrid_topk(spark, d):
    fused = _hybrid(spark, d)[1].fused
    return fused.select(
        "query_id",
        "rank",
        F.round("score", 8).alias("score"),
        "chunk_id",
        "fts_rank",
        "embedding_rank",
        F.round("fts_score", 6).alias("fts_score"),
        F.round("embedding_similarity", 5).alias("embedding_similarity"),
    )


def _query_set(spark, d) -> DataFrame:
    rows = fx.query_set(spark, d).withColumn("position", F.col("query_id"))
    optional = ("category", "evaluation_mode", "relevance_confidence")
    for name in optional:
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    checked = query_set(rows.withColumn("query_id", F.col("query_id").cast("string")))
    return checked.withColumn("query_id", F.col("query_id").cast("long")).drop(*optional)


@register
def test_query_set(spark, d):
    return _query_set(spark, d).select(
        "query_id", "query", F.array_join("known_relevant_documents", " ").alias("known")
    )


def _evaluated(spark, d) -> DataFrame:
    corpus, rankings = _hybrid(spark, d, k=10, pool_size=evaluation.POOL_SIZE)
    stored = hybrid.Rankings(
        *(materialize(ranking, "ranking") for ranking in (rankings.lexical, rankings.semantic)), None
    )
    fused = hybrid.fusion.fuse(stored.lexical, stored.semantic, 10)
    rankings = hybrid.Rankings(stored.lexical, stored.semantic, fused)
    test_queries = materialize(_query_set(spark, d), "queries")
    return evaluation.evaluate(test_queries, rankings, corpus.documents)


@register
def eval_per_query(spark, d):
    return _evaluated(spark, d).select(
        "query_id",
        *(f"{method}_rank" for method in evaluation.METHODS),
        "winner",
        evaluation.hit_vector(F.col("hybrid_rank")).alias("hits"),
    )


@register
def retrieval_eval(spark, d):
    shares = evaluation.summary(_evaluated(spark, d))
    rounded = (F.round(f"hit_at_{cutoff}", 6).alias(f"hit_at_{cutoff}") for cutoff in evaluation.CUTOFFS)
    return shares.select("method", "queries", *rounded)


@register
def eval_winner(spark, d):
    return evaluation.winners(_evaluated(spark, d))


def _sources(spark, d) -> tuple[DataFrame, DataFrame]:
    corpus, rankings = _hybrid(spark, d, prefer_reference=True)
    results = lexical.with_provenance(rankings.fused, corpus.texts, corpus.documents)
    return fx.queries(spark, d).select("query_id", "query"), context.select_sources(results)


@register
def context_sources(spark, d):
    return _sources(spark, d)[1]


@register
def context_blocks(spark, d):
    return context.assemble_context(*_sources(spark, d))


@register
def benchmark_context(spark, d):
    return context.assemble_context(*_sources(spark, d), benchmark=True)


def _citing(questions: DataFrame) -> DataFrame:
    """The queries as answers that cite the first source twice and one that may not exist."""
    other = F.concat(F.lit(" [1] \n["), (F.length("query") % 9).cast("string"), F.lit("][1]"))
    return questions.select("query_id", F.concat("query", other).alias("answer"))


@register
def used_sources(spark, d):
    questions, sources = _sources(spark, d)
    return context.used_sources(_citing(questions), sources).select(
        "query_id", "citation_id", "document_id", "display_path"
    )


@register
def citation_counts(spark, d):
    questions, sources = _sources(spark, d)
    return context.citation_counts(_citing(questions), sources)


@register
def cited_answer_parts(spark, d):
    questions, sources = _sources(spark, d)
    return context.link_citations(_citing(questions), sources)


@register
def final_answers(spark, d):
    """Answers with the reasoning taken out; some are empty, some have no source but PDF files."""
    questions, sources = _sources(spark, d)
    said = F.when(F.length("query") % 2 == 0, F.lit("")).otherwise(F.col("query"))
    answer = tx.strip_reasoning(F.concat(F.lit("<think>"), F.col("query"), F.lit("</think>"), said))
    stated = questions.select("query_id", answer.alias("answer"))
    return context.final_answers(stated, sources.filter("source_type <> 'pdf'"))


@register
def query_types(spark, d):
    turns = fx.table(spark, d, "conversations")
    question = F.when(F.col("role") == "user", F.col("text")).otherwise(
        F.concat("text", F.lit(" ЩО РЕГЛАМЕНТУЄ"))
    )
    return turns.select("conv_id", "turn", context.query_type(question).alias("query_type"))


# Answers


FLAG_COLUMNS = ("query_id", "model", "answer_chars", "source_count", *answers.FLAGS)


def _flagged(spark, d) -> DataFrame:
    return answers.with_flags(
        fx.answers(spark, d), SAMPLE_MARKERS["thinking"], SAMPLE_MARKERS["foreign"]
    )


@register
def answer_flags(spark, d):
    return answers.with_flags(fx.answers(spark, d)).select(*FLAG_COLUMNS)


@register
def answer_flags_sample(spark, d):
    return _flagged(spark, d).select(*FLAG_COLUMNS)


@register
def model_summary(spark, d):
    times = ("avg_total_time", "avg_llm_time")
    summary = answers.model_summary(_flagged(spark, d))
    return summary.withColumns({name: F.round(name, 6) for name in times})


@register
def model_compare(spark, d):
    return answers.compare_models(answers.select_models(_flagged(spark, d), skip=["m2"]))


@register
def model_compare_wide(spark, d):
    return answers.compare_wide(answers.compare_models(_flagged(spark, d)), ["m0", "m1", "m2"])


@register
def no_answer(spark, d):
    stated = F.when(
        F.length("answer") % 2 == 0, F.concat("answer", F.lit(" НЕМАЄ ІНФОРМАЦІЇ"))
    ).otherwise(F.col("answer"))
    return fx.answers(spark, d).select("query_id", answers.is_no_answer(stated).alias("no_answer"))
