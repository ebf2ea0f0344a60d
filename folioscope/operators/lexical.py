"""Full-text index over chunks and BM25 ranking for a whole table of queries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import index_tokens, query_tokens, strip
from folioscope.operators import stored
from folioscope.operators.blocks import BEST_SCHEMA, KEYS, BestRows, in_blocks, leaders, shares, slices
from folioscope.operators.spread import attach, heavy_keys
from folioscope.operators.stored import CHUNK, PartedTable, StoredIndex

# The BM25 parameters and the smallest weight of a term.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

# Query words plus queries that one pass hands to every task.
PASS_LIMIT = 200_000
SCORE_DIGITS = 10
# Cells of the score matrix, and uses of units by queries, that a task fills at a time.
CELLS = 1_000_000
# Chunks a task inverts at a time.
POSTING_ROWS = 2_000

# What a posting carries of its chunk: all that scores and filters need.
CARRIED = ("document_id", "chunk_index", "doc_len", "document_type", "content_category", "chunk_strategy")

INDEX_FIELDS = ("chunk_text", "filename", "path", "document_type", "content_category", "chunk_strategy")
PROVENANCE = (
    "filename",
    "path",
    "relative_path",
    "scan_root",
    "page_number",
    "chunk_index",
    "start_char",
    "end_char",
    "document_type",
    "content_category",
    "chunk_strategy",
    "chunk_text",
)


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the document columns that search and display use; chunks without a document are left out."""
    docs = documents.select(
        F.col("id").alias("document_id"),
        F.col("name").alias("filename"),
        "path",
        "relative_path",
        "scan_root",
        "document_type",
        "content_category",
        F.lit(True).alias("has_document"),
    )
    joined = attach(chunks, docs, "document_id", ["chunk_index"], heavy_keys(chunks, "document_id"))
    return joined.filter("has_document").drop("has_document")


def build_index(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per chunk: its tokens in text order, its length over all index fields, and what filters need.

    The index is partitioned by chunk: a query is scored where the tokens lie and only the best rows move.
    """
    joined = with_documents(chunks, documents)
    path = F.coalesce("relative_path", F.lit(""))
    others = F.concat_ws(
        " ", "filename", path, "document_type", F.coalesce("content_category", F.lit("")), "chunk_strategy"
    )
    tokens = index_tokens(F.col("chunk_text"))
    return joined.select(
        "chunk_id",
        "document_id",
        "chunk_index",
        "document_type",
        "content_category",
        "chunk_strategy",
        tokens.alias("tokens"),
        (F.size(tokens) + F.size(index_tokens(others))).alias("doc_len"),
    )


def _inverter(carried: Sequence[str]):
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, POSTING_ROWS)):
            lengths = batch["tokens"].value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            position = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            terms = batch["tokens"].flatten().dictionary_encode()
            cell = row * max(1, len(terms.dictionary)) + terms.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            bounds = np.r_[first, len(cell)]
            keys = batch.select(carried).take(pa.array(row[order[first]]))
            places = pa.ListArray.from_arrays(
                pa.array(bounds, pa.int32()), pa.array(position[order], pa.int32())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    terms.dictionary.take(terms.indices.take(pa.array(order[first]))),
                    *keys.columns,
                    pa.array(np.diff(bounds), pa.int64()),
                    places,
                ],
                names=["term", *carried, "tf", "positions"],
            )

    return invert


def postings(index: DataFrame, carried: Sequence[str] = KEYS) -> DataFrame:
    """Inverted form of the index: one row per chunk and term with its frequency and positions, and ``carried``
    columns of the chunk.

    All tokens of a chunk are in one row, so nothing has to be shuffled to group them.
    """
    rows = index.select(*carried, "tokens")
    kept = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema if field.name != "tokens")
    return rows.mapInArrow(_inverter(tuple(carried)), f"term string, {kept}, tf long, positions array<int>")


def store(index: DataFrame, path: str | None = None, chunk_buckets: int | None = None) -> StoredIndex:
    """Write ``index`` (a written table) in the form searches read: see ``stored``. ``stored.open_index`` reads it again."""
    return stored.store_index(index, lambda rows: postings(rows, CARRIED), path, chunk_buckets)


def term_stats(index: DataFrame) -> DataFrame:
    """Chunks per term."""
    terms = index.select(F.explode(F.array_distinct("tokens")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"),
        F.avg("doc_len").alias("avg_len"),
    )


def query_units(queries: DataFrame) -> DataFrame:
    """Scoring units of every query: the index tokens of each query token, in order.

    A token the index splits is a unit of several words that must stand together. A query without any token is one
    unit made of its whole text.
    """
    tokens = query_tokens(F.col("query"))
    parts = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(strip(F.col("query"))))
    exploded = queries.select("query_id", F.posexplode(parts).alias("position", "token"))
    return exploded.withColumn("words", index_tokens(F.col("token")))


def reference_boost(document_type: Column, content_category: Column) -> Column:
    reference = content_category == "reference"
    return (
        F.when(reference & (document_type == "standard_or_norms"), 5.0).when(reference, 1.0).otherwise(0.0)
    )


def chosen(
    rows: DataFrame,
    document_type: str | None = None,
    content_category: str | None = None,
    chunk_strategy: str | None = None,
) -> DataFrame:
    wanted = {
        "document_type": document_type,
        "content_category": content_category,
        "chunk_strategy": chunk_strategy,
    }
    for name, value in wanted.items():
        if value:
            rows = rows.filter(F.col(name) == value)
    return rows


@dataclass(frozen=True)
class QueryBlock:
    """The queries of one pass: how many units each has, and which queries use a unit, and how often."""

    sizes: dict
    users: dict[tuple[str, ...], Counter]

    @classmethod
    def of(cls, rows) -> QueryBlock:
        sizes, users = Counter(), {}
        for row in rows:
            sizes[row["query_id"]] += 1
            if row["words"]:
                users.setdefault(tuple(row["words"]), Counter())[row["query_id"]] += 1
        return cls(sizes, users)


@dataclass(frozen=True)
class IndexStats:
    """Stored statistics of an index: ``terms`` from ``term_stats`` and ``corpus`` from ``corpus_stats``."""

    terms: DataFrame
    corpus: DataFrame


def phrase_postings(index: StoredIndex, phrases: DataFrame) -> DataFrame:
    """Postings of phrases, from the positions of their words: a row for each chunk in which the words of a phrase stand
    one after the other, with their frequency there as ``tf``.

    ``phrases`` has unit, place, length and term, a row for each word. The positions of a word, less its place in the
    phrase, are where the phrase would start; it does where the positions of all words agree. Postings of a chunk are in
    one bucket, so nothing is shuffled.
    """
    words, buckets = index.located(phrases)
    starts = F.transform("positions", lambda position: position - F.col("place"))
    rest = [name for name in CARRIED if name not in CHUNK]
    met = index.postings_of(words, buckets).groupBy(*CHUNK, "unit").agg(
        F.count("*").alias("found"),
        F.first("length").alias("length"),
        F.collect_list(starts).alias("starts"),
        *(F.first(name).alias(name) for name in rest),
    )
    common = F.aggregate(
        F.slice("starts", F.lit(2), F.col("length")),
        F.get("starts", F.lit(0)),
        lambda agreed, more: F.array_intersect(agreed, more),
    )
    # Chunks that lack a word are left out before positions are compared.
    whole = met.filter(F.col("found") == F.col("length")).withColumn("tf", F.size(common).cast("long"))
    return whole.filter("tf > 0").select("unit", *CARRIED, "tf")


def _weights(frequencies: dict, n_chunks: int) -> dict:
    """Inverse document frequency of every unit, never below the floor."""
    found = {unit: math.log((n_chunks - df + 0.5) / (df + 0.5)) for unit, df in frequencies.items()}
    return {unit: weight if weight > 0 else IDF_FLOOR for unit, weight in found.items()}


@dataclass(frozen=True)
class Scoring:
    """What a task needs of a pass: the weight of each unit, its queries (``users`` from ``starts``) and how often each
    uses it, the units of each query, and the mean length of a chunk."""

    idf: np.ndarray
    starts: np.ndarray
    users: np.ndarray
    times: np.ndarray
    sizes: np.ndarray
    mean: float


def _by_chunk(hits: DataFrame, boost: Column) -> DataFrame:
    """A row for each chunk with the units it holds and their frequencies."""
    rows = hits.withColumn("boost", boost).groupBy(*CHUNK)
    return rows.agg(
        F.first("doc_len").alias("doc_len"),
        F.first("boost").alias("boost"),
        F.collect_list(F.struct("unit", "tf")).alias("units"),
    )


def _joined(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Rows of ``_by_chunk`` of words and phrases as one; both lie by chunk, so nothing is shuffled."""
    more = phrases.select(*CHUNK, *(F.col(name).alias(f"phrase_{name}") for name in ("doc_len", "boost", "units")))
    return words.join(more, list(CHUNK), "full_outer").select(
        *CHUNK,
        *(F.coalesce(name, f"phrase_{name}").alias(name) for name in ("doc_len", "boost")),
        F.flatten(F.array_compact(F.array("units", "phrase_units"))).alias("units"),
    )


def _spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``first`` to ``first + counts - 1`` of each entry, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - first, counts)


def _scorer(shared, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        n_queries, n_users = len(given.sizes), np.diff(given.starts)
        best = BestRows(n_queries, k, CHUNK)
        for batch in batches:
            entries = batch["units"].flatten()
            unit = entries.field("unit").to_numpy()
            tf = entries.field("tf").to_numpy()
            held = batch["units"].value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), held)
            ratio = batch["doc_len"].to_numpy()[row] / given.mean
            weight = given.idf[unit] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))
            boost = batch["boost"].to_numpy()
            cost = n_queries + np.bincount(row, n_users[unit], batch.num_rows)
            ends = np.cumsum(held)
            for low, high in shares(cost, CELLS):
                part = slice(ends[low] - held[low], ends[high - 1])
                counts = n_users[unit[part]]
                used = _spans(given.starts[unit[part]], counts)
                cell = np.repeat(row[part] - low, counts) * n_queries + given.users[used]
                shape = (high - low, n_queries)
                size = shape[0] * n_queries
                matched = np.bincount(cell, given.times[used], size).reshape(shape)
                points = np.bincount(cell, np.repeat(weight[part], counts) * given.times[used], size).reshape(shape)
                points += boost[low:high, None]
                complete = matched == given.sizes
                # Lifts chunks with every unit above all others of the slice.
                lift = points.max() + 1
                open_cells = leaders(np.where(matched > 0, points + lift * complete, -np.inf), k)
                at, query = np.nonzero(open_cells)
                found = points[at, query]
                best.add(batch, query, at + low, complete[at, query], np.round(found, SCORE_DIGITS), found)
        yield from best.batches()

    return score


def _search_pass(
    index: StoredIndex, queries: DataFrame, k: int, boost: Column, wanted: dict, stats: IndexStats | None
) -> DataFrame:
    """Scores of the chunks that hold a unit of a query, of each task the best ``k`` of every query.

    Words read the postings of their buckets. All postings of a chunk are in one task, so they are grouped without a
    shuffle, a row for each chunk; chunks are scored slice by slice against the queries of the pass, which are broadcast.
    """
    spark = queries.sparkSession
    block = QueryBlock.of(query_units(queries).select("query_id", "words").collect())
    kind = _type(queries, "query_id")
    ids = {query_id: number for number, query_id in enumerate(block.sizes)}
    names = spark.createDataFrame(
        [(number, query_id) for query_id, number in ids.items()], f"query int, query_id {kind}"
    )
    units = list(block.users)
    if not units:
        return spark.createDataFrame([], BEST_SCHEMA.replace("chunk_id string, ", "")).join(names, "query")
    words, buckets = index.located(
        spark.createDataFrame(
            [(number, unit[0]) for number, unit in enumerate(units) if len(unit) == 1], "unit int, term string"
        )
    )
    phrases = [
        (number, place, len(unit), word)
        for number, unit in enumerate(units)
        if len(unit) > 1
        for place, word in enumerate(unit)
    ]
    counted = stats.terms.join(F.broadcast(words), "term") if stats else index.terms_of(words, buckets)
    df = dict.fromkeys(range(len(units)), 0)
    df |= {row.unit: row.df for row in counted.select("unit", "df").collect()}
    hits = _by_chunk(chosen(index.postings_of(words, buckets), **wanted), boost)
    if phrases:
        given = spark.createDataFrame(phrases, "unit int, place int, length int, term string")
        together = phrase_postings(index, given)
        df |= {row.unit: row["count"] for row in together.groupBy("unit").count().collect()}
        hits = _joined(hits, _by_chunk(chosen(together, **wanted), boost))
    totals = stats.corpus.first() if stats else index
    mean = (totals.total_len / totals.n_chunks if totals.n_chunks else 0) or 1.0
    weights = _weights(df, totals.n_chunks)
    uses = [[(ids[query_id], times) for query_id, times in block.users[unit].items()] for unit in units]
    shared = spark.sparkContext.broadcast(
        Scoring(
            np.array([weights[number] for number in range(len(units))]),
            np.cumsum([0, *(len(used) for used in uses)]),
            np.array([query for used in uses for query, _ in used], np.int64),
            np.array([times for used in uses for _, times in used], np.float64),
            np.array([block.sizes[query_id] for query_id in ids], np.float64),
            mean,
        )
    )
    scored = hits.mapInArrow(_scorer(shared, k), BEST_SCHEMA.replace("chunk_id string, ", ""))
    return scored.join(F.broadcast(names), "query")


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def search(
    index: DataFrame | StoredIndex,
    queries: DataFrame,
    k: int = 10,
    prefer_reference: bool = False,
    document_type: str | None = None,
    content_category: str | None = None,
    chunk_strategy: str | None = None,
    stats: IndexStats | None = None,
) -> DataFrame:
    """Ranked chunks per query: those with every unit, or with any unit where no chunk has them all.

    Filters act before that choice. Term statistics come from the whole index: from ``stats`` if given, else from those
    stored with it; those of a phrase are counted. ``queries`` has query_id and query; an id that is there twice is an
    error. An ``index`` that is not stored is written first: store one that is searched more than once.
    """
    if not isinstance(index, StoredIndex):
        index = store(index)
    boost = (
        reference_boost(F.col("document_type"), F.col("content_category")) if prefer_reference else F.lit(0.0)
    )
    wanted = {
        "document_type": document_type,
        "content_category": content_category,
        "chunk_strategy": chunk_strategy,
    }
    words = F.size(F.regexp_extract_all("query", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    scored = in_blocks(
        queries.select("query_id", "query"),
        words + 1,
        PASS_LIMIT,
        k,
        lambda block: _search_pass(index, block, k, boost, wanted, stats),
    )
    # Spark cuts each task's rows to the first k of a query before it shuffles them.
    by_score = Window.partitionBy("query_id").orderBy(F.desc("complete"), F.desc("ranking"), *CHUNK)
    ranked = scored.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    best = F.max("complete").over(Window.partitionBy("query_id"))
    kept = ranked.withColumn("best_class", best).filter(F.col("complete") == F.col("best_class"))
    kept = kept.select("query_id", "rank", "score", *CHUNK, (F.col("complete") == 1).alias("all_terms"))
    named = stored.fetch(kept, index.chunks, ["chunk_id"])
    return named.select("query_id", "rank", "score", *KEYS, "all_terms")


def with_provenance(results: DataFrame, chunks: DataFrame | PartedTable, documents: DataFrame) -> DataFrame:
    """Results with text and document columns, fetched only for the rows that made the ranking: of a stored chunk table
    only the folders of their documents are read."""
    docs = documents.select(
        F.col("id").alias("document_id"),
        F.col("name").alias("filename"),
        "path",
        "relative_path",
        "scan_root",
        "document_type",
        "content_category",
    )
    if isinstance(chunks, PartedTable):
        missing = [name for name in PROVENANCE if name in chunks.table.columns and name not in results.columns]
        found = stored.fetch(results, chunks, missing)
    else:
        wanted = results.select("chunk_id").distinct()
        text = chunks.drop("document_id", "chunk_index").join(wanted, "chunk_id")
        found = results.join(text, "chunk_id")
    joined = found.join(docs, "document_id")
    return joined.select(*results.columns, *(name for name in PROVENANCE if name not in results.columns))
