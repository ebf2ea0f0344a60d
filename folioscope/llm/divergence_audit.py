"""How far the sources of a language differ in their words: run-length columns over a reordered vocabulary.

Each language keeps the words of enough of its documents. A source is a column of counts over that vocabulary. The
vocabulary is sorted so that equal counts stand together, each column becomes runs of equal counts, and two columns are
compared run by run: where runs of both overlap, the difference of their shares counts once for the length of the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch, batches_of
from folioscope.llm.words import LOWER, _segments, byte_class, text_bytes

LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
# Bytes of text that are counted at a time.
SLICE_BYTES = 8 << 20
# Bytes of one text whose words are coded at a time.
MOST_BYTES = 32 << 20
# Places of the vocabulary in one block, and columns in one tile: what a task decodes at a time.
BLOCK_BITS = 14
TILE = 32
# Columns that lead the order of the vocabulary.
LEADING = 8


@dataclass(frozen=True)
class AuditOptions:
    """Words in at least ``least_documents`` documents of a language; shares are of ``scale``, each count ``smoothing``
    more; ``top`` words a source."""

    least_documents: int = 30
    smoothing: int = 5
    scale: int = 1_000_000_000
    top: int = 50


def _words(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> tuple[np.ndarray, pa.Array]:
    """The document (place in the batch) and the lower-cased letters of each word of a segment."""
    piece = data[first:last]
    inside = LETTERS[piece]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, last)] - first
    begins[cuts[inside[cuts]]] = True
    start = np.flatnonzero(begins)
    document = np.searchsorted(offsets, start + first, side="right") - 1
    # The words one after the other are the body of a string column.
    body = LOWER[piece[inside]]
    edges = np.append((np.cumsum(inside, dtype=np.int64) - 1)[start], len(body))
    return document, pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edges), pa.py_buffer(body))


def _in_documents(parts: list[tuple[np.ndarray, pa.Array]]) -> pa.Table:
    """``document``, ``term`` and ``n`` of words, each term of a document once."""
    coded = pa.chunked_array([words for _, words in parts], pa.large_string()).combine_chunks().dictionary_encode()
    width = max(1, len(coded.dictionary))
    document = np.concatenate([documents for documents, _ in parts])
    cell, n = np.unique(document * width + coded.indices.to_numpy(), return_counts=True)
    return pa.table({"document": cell // width, "term": pa.DictionaryArray.from_arrays(cell % width, coded.dictionary), "n": n})


def _term_counts(batch: pa.RecordBatch) -> pa.Table | None:
    """``lang``, ``source``, ``term``, ``n`` (places) and ``docs`` (rows with the term) of a batch of texts."""
    data, offsets = text_bytes(batch.column("text"))
    tables, parts, held = [], [], 0
    for first, last in _segments(data, LETTERS):
        parts.append(_words(data, offsets, first, last))
        held += last - first
        if held > MOST_BYTES:
            tables.append(_in_documents(parts))
            parts, held = [], 0
    if parts:
        tables.append(_in_documents(parts))
    if not tables:
        return None
    counted = tables[0]
    if len(tables) > 1:
        # A text too long for one table: its words meet by their letters.
        plain = pa.concat_tables([table.set_column(1, "term", table.column("term").cast(pa.large_string())) for table in tables])
        summed = plain.group_by(["document", "term"]).aggregate([("n", "sum")]).rename_columns(["document", "term", "n"])
        counted = summed.set_column(1, "term", summed.column("term").dictionary_encode())
    counted = counted.combine_chunks()
    rows = pa.table({"lang": batch.column("lang"), "source": batch.column("source"), "row": np.arange(batch.num_rows)})
    firsts = rows.group_by(["lang", "source"]).aggregate([("row", "min")])
    group = rows.join(firsts, ["lang", "source"]).sort_by("row").column("row_min").to_numpy()
    term = counted.column("term").combine_chunks()
    term = term.chunk(0) if isinstance(term, pa.ChunkedArray) else term
    width = max(1, len(term.dictionary))
    cell = group[counted.column("document").to_numpy()] * width + term.indices.to_numpy()
    order = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.diff(cell[order], prepend=-1))
    found = cell[order][first]
    n = counted.column("n").to_numpy()[order]
    at = pa.array(found // width)
    return pa.table(
        {
            "lang": rows.column("lang").take(at),
            "source": rows.column("source").take(at),
            "term": term.dictionary.take(pa.array(found % width)),
            "n": np.add.reduceat(n, first) if len(first) else n,
            "docs": np.diff(np.append(first, len(order))),
        }
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each slice of a task's texts. Spark combines them before the shuffle."""
    for whole in batches:
        for batch in batches_of(whole, "text", SLICE_BYTES):
            counted = _term_counts(batch)
            if counted is not None:
                yield from counted.cast(_COUNTED).combine_chunks().to_batches()


_COUNTED = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]
)


def share(count: Column, total: Column, words: Column, options: AuditOptions) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * words)), in whole numbers of 38 digits."""
    over = (count + options.smoothing).cast("decimal(19,0)") * F.lit(options.scale).cast("decimal(10,0)")
    under = (total + options.smoothing * words).cast("decimal(19,0)")
    # Remainder and exact quotient instead of a rounded division.
    return (1 + F.call_function("div", over, under)).cast("long")


def _encode(group: pa.Table) -> pa.Table:
    """One row for each column of a block: where its runs start and their values, over all places of the block."""
    group = group.combine_chunks()
    number = group.column("number").to_numpy()
    place = group.column("place").to_numpy()
    values = group.column("p").to_numpy()
    words = int(pc.max(group.column("words")).as_py())
    order = np.argsort(number, kind="stable")
    edges = np.flatnonzero(np.diff(number[order], prepend=-1, append=-1))
    starts, runs, numbers = [], [], []
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        rows = order[first:last]
        base = rows[place[rows] < 0][0]
        column = np.full(words, values[base])
        rows = rows[place[rows] >= 0]
        column[place[rows]] = values[rows]
        start = np.flatnonzero(np.diff(column, prepend=column[:1] - 1))
        starts.append(start.astype(np.int32))
        runs.append(column[start])
        numbers.append(int(number[base]))
    lang, block = group.column("lang")[0].as_py(), group.column("block")[0].as_py()
    return pa.table(
        {
            "lang": pa.array([lang] * len(numbers), pa.string()),
            "block": pa.array([block] * len(numbers), pa.int64()),
            "number": pa.array(numbers, pa.int32()),
            "words": pa.array([words] * len(numbers), pa.int32()),
            "starts": pa.array(starts, pa.list_(pa.int32())),
            "runs": pa.array(runs, pa.list_(pa.int64())),
        }
    )


def overlap_sum(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], words: int) -> int:
    """Sum of the absolute differences of two run-length columns (starts, values) over ``words`` places."""
    cuts = np.union1d(left[0], right[0])
    lengths = np.diff(np.append(cuts, words))
    one = left[1][np.searchsorted(left[0], cuts, side="right") - 1]
    other = right[1][np.searchsorted(right[0], cuts, side="right") - 1]
    return int((np.abs(one - other) * lengths).sum())


def _compare(group: pa.Table) -> pa.Table:
    """Differences of all column pairs of two tiles in one block."""
    group = group.combine_chunks()
    words = int(group.column("words")[0].as_py())
    tiles = group.column("number").to_numpy() // TILE
    low, high = int(group.column("low")[0].as_py()), int(group.column("high")[0].as_py())
    columns = [
        (number, (np.asarray(starts.values), np.asarray(runs.values)))
        for number, starts, runs in zip(
            group.column("number").to_pylist(), group.column("starts").combine_chunks(), group.column("runs").combine_chunks()
        )
    ]
    lefts = [column for column, tile in zip(columns, tiles) if tile == low]
    rights = [column for column, tile in zip(columns, tiles) if tile == high]
    found = [
        (one, other, overlap_sum(left, right, words) if words else 0)
        for one, left in lefts
        for other, right in rights
        if one < other
    ]
    names = pa.array([group.column("lang")[0].as_py()] * len(found), pa.string())
    one, other, value = zip(*found) if found else ((), (), ())
    return pa.table(
        [names, pa.array(one, pa.int32()), pa.array(other, pa.int32()), pa.array(value, pa.int64())],
        names=["lang", "one", "other", "value"],
    )


@dataclass(frozen=True)
class Audit:
    """Written tables of one audit: ``groups`` (lang, source, number, total, words, zero: the share of a word that does
    not occur) and ``entries`` (lang, source, number, term, n, p, q, block, place)."""

    groups: DataFrame
    entries: DataFrame
    blocks: DataFrame


def audit_tables(docs: DataFrame, options: AuditOptions) -> Audit:
    scratch = Scratch(docs.sparkSession, "audit")
    read = docs.select(
        *(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("lang", "source", "text"))
    )
    schema = "lang string, source string, term string, n long, docs long"
    partial = read.mapInArrow(_count, schema)
    keys = ["lang", "source", "term"]
    counted = scratch.write(partial.groupBy(keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    # Sources are numbered by how many different counts they have: the fewest lead the order of the vocabulary.
    kinds = counted.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    kinds = kinds.groupBy("lang", "source").agg(F.count("*").alias("kinds"))
    named = read.select("lang", "source").distinct().join(kinds, ["lang", "source"], "left")
    in_lang = Window.partitionBy("lang").orderBy(F.coalesce("kinds", F.lit(0)).desc(), "source")
    numbered = named.withColumn("number", (F.row_number().over(in_lang) - 1).cast("int"))
    from_last = Window.partitionBy("lang").orderBy(F.col("number").desc())
    numbered = scratch.write(numbered.withColumn("lead", F.row_number().over(from_last)).drop("kinds"), "numbered")

    leads = numbered.filter(F.col("lead") <= LEADING).select("lang", "source", "lead")
    led = counted.join(leads, ["lang", "source"], "left")
    terms = led.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"),
        F.sum("n").alias("of_lang"),
        # Equal for words with equal counts in every source.
        F.sum(F.shiftright(F.xxhash64("source", "n"), 24)).alias("vector"),
        *(F.max(F.when(F.col("lead") == n, F.col("n")).otherwise(0)).alias(f"lead{n}") for n in range(1, LEADING + 1)),
    )
    terms = terms.filter(F.col("docs") >= options.least_documents)
    order = ["lang", *(f"lead{n}" for n in range(1, LEADING + 1)), "of_lang", "vector", "term"]
    spot = F.monotonically_increasing_id()
    sorted_terms = terms.repartitionByRange(*order).sortWithinPartitions(*order)
    vocabulary = scratch.write(sorted_terms.select("lang", "term", "of_lang", spot.alias("spot")), "vocabulary")
    block = F.shiftright("spot", BLOCK_BITS)
    blocks = vocabulary.groupBy("lang", block.alias("block")).agg(
        F.min("spot").alias("first"), F.count("*").cast("int").alias("words")
    )
    blocks = scratch.write(blocks, "blocks")
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("words"), F.sum("of_lang").alias("lang_total"))

    placed = vocabulary.withColumn("block", block).join(blocks.select("lang", "block", "first"), ["lang", "block"])
    placed = placed.select("lang", "term", "of_lang", "block", (F.col("spot") - F.col("first")).cast("int").alias("place"))
    met = scratch.write(counted.drop("docs").join(placed, ["lang", "term"]), "met")
    totals = met.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = numbered.drop("lead").join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select(
        "lang", "source", "number", *(F.coalesce(name, F.lit(0)).alias(name) for name in ("total", "words", "lang_total"))
    )
    zero = F.when(F.col("words") > 0, share(F.lit(0), F.col("total"), F.greatest("words", F.lit(1)), options))
    groups = scratch.write(groups.withColumn("zero", zero.otherwise(0)), "groups")
    entries = met.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "number",
        "term",
        "n",
        share(F.col("n"), F.col("total"), F.col("words"), options).alias("p"),
        share(F.col("of_lang"), F.col("lang_total"), F.col("words"), options).alias("q"),
        "block",
        "place",
    )
    return Audit(groups, scratch.write(entries, "entries"), blocks)


def pair_distances(audit: Audit) -> DataFrame:
    """``lang``, ``one``, ``other`` (numbers of sources, one < other) and ``value`` for every pair of sources.

    Work is cut into blocks of 2^14 places and tiles of 32 columns; a task decodes one block of two tiles. Every source
    has a row in every block, without words too (its runs are one), and a language without words has one empty block.
    """
    groups = audit.groups
    whole = groups.select("lang").distinct().select(
        "lang", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("words")
    )
    blocks = audit.blocks.select("lang", "block", "words").unionByName(whole)
    every = groups.select("lang", "number", F.col("zero").alias("p")).join(blocks, "lang")
    every = every.select("lang", "block", "number", F.lit(-1).alias("place"), "p", "words")
    entries = audit.entries.select("lang", "block", "number", "place", "p", F.lit(0).alias("words"))
    tile = F.floor(F.col("number") / TILE).cast("int")
    cells = every.unionByName(entries).withColumn("tile", tile)
    columns = cells.groupBy("lang", "block", "tile").applyInArrow(
        _encode, "lang string, block long, number int, words int, starts array<int>, runs array<long>"
    )
    columns = Scratch(groups.sparkSession, "audit").write(columns, "columns")
    tiles = groups.groupBy("lang").agg((F.floor(F.max("number") / TILE) + 1).cast("int").alias("tiles"))
    sent = columns.join(tiles, "lang").withColumn("tile", tile)
    sent = sent.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sent = sent.select(
        *columns.columns, F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high")
    )
    compared = sent.groupBy("lang", "block", "low", "high").applyInArrow(
        _compare, "lang string, one int, other int, value long"
    )
    return compared.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, options: AuditOptions | None = None) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` per source of each language.

    Part ``pair``: every other source of the language by its distance, the sum of abs(p - p') over the kept words. Part
    ``term``: the words that the source has and that have a greater share p there than in the language, by p - q, first
    ``top`` of them. Ranks go by value, descending, then by item.

    Cases: null text, lang and source are empty strings; every row is a document, with a repeated id too; sources without
    words take part with the share of words that do not occur; in a language without kept words all distances are 0; one
    source alone has no pairs; an empty table gives no rows; other columns are not read. Arithmetic is in whole numbers.
    """
    options = options or AuditOptions()
    tables = audit_tables(docs, options)
    names = tables.groups.select("lang", "number", "source")
    pairs = pair_distances(tables)
    both = pairs.unionByName(pairs.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value"))
    items = names.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    pairs = both.join(names.withColumnRenamed("number", "one"), ["lang", "one"]).join(items, ["lang", "other"])
    terms = tables.entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= options.top)
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(by_value))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        terms.withColumn("part", F.lit("term")).select(*columns)
    )


def oracle(options: AuditOptions = AuditOptions()) -> str:
    """The audit of ``documents`` in DuckDB SQL."""

    def ratio(count: str, total: str, words: str) -> str:
        over = f"({options.scale}::HUGEINT * ({count} + {options.smoothing}))"
        return f"(1 + {over} // ({total} + {options.smoothing} * {words})::HUGEINT)::BIGINT"

    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
tokens AS (SELECT id, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term
  HAVING count(DISTINCT id) >= {options.least_documents}),
langs AS (SELECT lang, count(*) AS words, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source)
  GROUP BY lang, source),
cells AS (SELECT lang, source, term, coalesce(counts.n, 0) AS n,
    {ratio("coalesce(counts.n, 0)", "totals.total", "langs.words")} AS p,
    {ratio("kept.n", "langs.total", "langs.words")} AS q
  FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT one.lang, one.source, 'pair' AS part, other.source AS item, coalesce(value, 0) AS value
  FROM groups AS one JOIN groups AS other ON one.lang = other.lang AND one.source <> other.source
  LEFT JOIN (SELECT a.lang, a.source AS x, b.source AS y, sum(abs(a.p - b.p)) AS value FROM cells AS a JOIN cells AS b
    ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) AS sums
  ON sums.lang = one.lang AND x = one.source AND y = other.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= {options.top}
"""
