"""Benchmark decontamination: which training documents contain word n-grams of test items, and removing them.

The n-grams of the benchmark, as hashes of normalised words, are broadcast; documents are scanned where they lie,
without a shuffle. A hit on a hash is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch, batches_of
from folioscope.llm.words import LETTERS_DIGITS, text_bytes, windows, words


@dataclass(frozen=True)
class ScanOptions:
    """``width`` words make a window; an item of fewer words is one window. At most ``broadcast_bytes`` of benchmark
    text are broadcast at once (about 20 bytes a byte of text); a larger benchmark is scanned for in several passes."""

    width: int = 10
    broadcast_bytes: int = 4 << 20


class Index:
    """Windows of benchmark items by width: sorted distinct hashes, the word hashes of each, and who has it."""

    def __init__(self, items: list[str], texts: pa.Array, width: int) -> None:
        data, offsets = text_bytes(texts)
        hashes, _, _, first = words(data, offsets, LETTERS_DIGITS)
        by_width: dict[int, list[tuple[int, int]]] = {}
        for item, (begin, end) in enumerate(zip(first[:-1], first[1:])):
            own = min(width, int(end - begin))
            for place in range(begin, end - own + 1) if own else ():
                by_width.setdefault(own, []).append((place, item))
        self.items = items
        self.tables = []
        for own, found in sorted(by_width.items()):
            places, owners = np.array(found).T
            gram = windows(hashes, own)[places]
            order = np.argsort(gram, kind="stable")
            gram, places, owners = gram[order], places[order], owners[order]
            keys, start = np.unique(gram, return_index=True)
            content = hashes[places[start][:, None] + np.arange(own)]
            marks = np.zeros(1 << 22, bool)
            marks[keys >> np.uint64(42)] = True
            self.tables.append((own, keys, np.append(start, len(gram)), owners, content, marks))

    def hits(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """Per text: number of words, the maximal runs of hit words, names of the items. A run is a column of first
        word, word behind, first byte, byte behind."""
        data, offsets = text_bytes(column)
        hashes, starts, ends, first = words(data, offsets, LETTERS_DIGITS)
        change = np.zeros(len(hashes) + 1, np.int64)
        named: dict[int, set[str]] = {}
        for own, keys, slots, owners, content, marks in self.tables:
            gram = windows(hashes, own)
            place = np.flatnonzero(marks[gram >> np.uint64(42)])
            slot = np.minimum(np.searchsorted(keys, gram[place]), len(keys) - 1)
            place, slot = place[keys[slot] == gram[place]], slot[keys[slot] == gram[place]]
            same = np.ones(len(place), bool)
            for word in range(own):
                same &= hashes[place + word] == content[slot, word]
            text = np.searchsorted(first, place, side="right") - 1
            same &= place + own <= first[text + 1]
            place, slot, text = place[same], slot[same], text[same]
            np.add.at(change, place, 1)
            np.add.at(change, place + own, -1)
            for pair in np.unique(text * len(keys) + slot) if len(text) else ():
                at, which = divmod(int(pair), len(keys))
                named.setdefault(at, set()).update(
                    self.items[owner] for owner in owners[slots[which] : slots[which + 1]]
                )
        hit = np.cumsum(change[:-1]) > 0
        for at, (begin, end) in enumerate(zip(first[:-1], first[1:])):
            if at not in named:
                yield int(end - begin), np.zeros((4, 0), np.int64), set()
                continue
            own = np.concatenate([[False], hit[begin:end], [False]]).astype(np.int8)
            edges = np.diff(own)
            one, two = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            base = offsets[at]
            runs = np.stack([one, two, starts[begin + one] - base, ends[begin + two - 1] - base])
            yield int(end - begin), runs, named[at]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _parts(benchmark: DataFrame, options: ScanOptions) -> int:
    size = _items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // options.broadcast_bytes))


def indexes(benchmark: DataFrame, options: ScanOptions) -> Iterator[Index]:
    """The benchmark in as many parts as the broadcast bound asks for. Its texts pass through the driver part by
    part; a part is larger than the bound only as far as hashing deals items unevenly, or by one long item."""
    parts = _parts(benchmark, options)
    for part in range(parts):
        table = _items(benchmark).filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).toArrow()
        if table.num_rows:
            yield Index(table.column("item").to_pylist(), table.column("text").combine_chunks(), options.width)


RUN = "struct<first: long, behind: long, start: long, end: long>"
SCANNED = f"doc_id long, key long, n_words long, hits array<{RUN}>, items array<string>"
_RUN = pa.struct([(name, pa.int64()) for name in ("first", "behind", "start", "end")])


def _scanned(doc: pa.Array, key: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            doc,
            key,
            pa.array([row[0] for row in rows], pa.int64()),
            pa.array([row[1] for row in rows], pa.list_(_RUN)),
            pa.array([row[2] for row in rows], pa.list_(pa.string())),
        ],
        ["doc_id", "key", "n_words", "hits", "items"],
    )


def _scanning(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in batches_of(whole, "text"):
                rows = []
                for place, (count, runs, names) in enumerate(index.hits(batch.column("text"))):
                    found = []
                    if runs.size:
                        body = np.frombuffer(batch.column("text")[place].as_py().encode(), np.uint8)
                        points = np.cumsum((body & 0xC0) != 0x80)
                        runs = np.stack([runs[0], runs[1], points[runs[2]] - 1, points[runs[3] - 1]])
                        found = [dict(zip(("first", "behind", "start", "end"), run)) for run in runs.T.tolist()]
                    rows.append((count, found, sorted(names)))
                yield _scanned(batch.column("doc_id"), batch.column("key"), rows)

    return task


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that several parts found in a row, put together where they touch or overlap."""
    for batch in batches:
        rows = []
        for count, runs, names in zip(*(batch.column(name).to_pylist() for name in ("n_words", "hits", "items"))):
            merged: list[dict] = []
            for run in sorted(runs, key=lambda run: run["first"]):
                if merged and run["first"] <= merged[-1]["behind"]:
                    if run["behind"] > merged[-1]["behind"]:
                        merged[-1] |= {"behind": run["behind"], "end": run["end"]}
                else:
                    merged.append(dict(run))
            rows.append((count, merged, sorted(set(names))))
        yield _scanned(batch.column("doc_id"), batch.column("key"), rows)


def scan(docs: DataFrame, benchmark: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``key`` (hash of the text), ``n_words``, ``hits`` (maximal runs of hit words,
    as word numbers and as code points, ends exclusive) and ``items`` (ids of the items with an occurring window, as
    sorted strings).

    Cases: a null or empty text has no words; an item without words has no windows; an item without id is named by an
    empty string; equal items count once each; an empty benchmark hits nothing; rows that repeat are scanned each;
    other columns are ignored. A benchmark over the broadcast bound takes one pass per part, whose results are then
    put together by document.
    """
    options = options or ScanOptions()
    spark = docs.sparkSession
    scratch = Scratch(spark, "contamination")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    parts: list[DataFrame] = []
    several = _parts(benchmark, options) > 1
    for index in indexes(benchmark, options):
        found = rows.mapInArrow(_scanning(spark.sparkContext.broadcast(index)), SCANNED)
        parts.append(scratch.write(found.dropDuplicates(["doc_id", "key"]), "part") if several else found)
    if not parts:
        nothing = Index([], pa.array([], pa.string()), options.width)
        parts.append(rows.mapInArrow(_scanning(spark.sparkContext.broadcast(nothing)), SCANNED))
    if not several:
        return parts[0]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    together = (
        union.groupBy("doc_id", "key", "n_words")
        .agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        .mapInArrow(_joined, SCANNED)
    )
    other = together.withColumnsRenamed({"doc_id": "doc_of", "key": "key_of"})
    return (
        rows.select("doc_id", "key")
        .join(other, F.col("doc_id").eqNullSafe(F.col("doc_of")) & F.col("key").eqNullSafe(F.col("key_of")))
        .select("doc_id", "key", "n_words", "hits", "items")
    )


def report(docs: DataFrame, benchmark: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """The scan as counts: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, run: total + run["behind"] - run["first"])
    return scan(docs, benchmark, options).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _removing(shared, spans: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in batches_of(whole, "text"):
                found = list(index.hits(batch.column("text")))
                if not spans:
                    yield batch.filter(pa.array([not runs.size for _, runs, _ in found], pa.bool_()))
                    continue
                texts = batch.column("text").to_pylist()
                for place, (_, runs, _) in enumerate(found):
                    if runs.size:
                        body = texts[place].encode()
                        edges = [0, *runs[2:].T.reshape(-1).tolist(), len(body)]
                        pieces = (body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                        texts[place] = b"".join(pieces).decode()
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return task


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, options: ScanOptions | None = None, remove: str = "documents"
) -> DataFrame:
    """The rows of ``docs`` without contaminated documents (``remove="documents"``), or with the hit words cut out of
    their texts (``remove="spans"``). All columns stay as they are; cases as in ``scan``.

    A benchmark over the broadcast bound is taken part by part; documents that an earlier part removed are not scanned
    again. Cutting spans of several parts first finds them all, as a cut could join words to a new window.
    """
    options = options or ScanOptions()
    spark = docs.sparkSession
    Scratch(spark, "contamination")
    if remove == "spans" and _parts(benchmark, options) > 1:
        found = scan(docs, benchmark, options).filter(F.size("hits") > 0).dropDuplicates(["doc_id", "key"])
        taken = {name.lower() for name in docs.columns}
        new = {name: next(name + "_" * n for n in range(1, 99) if name + "_" * n not in taken) for name in found.columns}
        found = found.select(*(F.col(name).alias(new[name]) for name in ("doc_id", "key", "hits")))
        same = docs["doc_id"].cast("long").eqNullSafe(F.col(new["doc_id"])) & F.xxhash64(docs["text"]).eqNullSafe(
            F.col(new["key"])
        )
        joined = docs.join(found, same, "left")
        ends = F.concat(F.array(F.lit(0)), F.transform(new["hits"], lambda run: run["end"]))
        starts = F.concat(F.transform(new["hits"], lambda run: run["start"]), F.array(F.length("text").cast("long")))
        pieces = F.zip_with(ends, starts, lambda one, two: F.substr("text", one + 1, two - one))
        text = F.when(F.col(new["hits"]).isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))
        return joined.select(*(text.alias("text") if name == "text" else F.col(f"`{name}`") for name in docs.columns))
    kept = docs
    for index in indexes(benchmark, options):
        kept = kept.mapInArrow(_removing(spark.sparkContext.broadcast(index), remove == "spans"), docs.schema)
    return kept


def oracle(options: ScanOptions = ScanOptions()) -> str:
    """The report in DuckDB SQL."""
    return f"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, width, array_to_string(w[i : i + width - 1], ' ') AS gram FROM
    (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM
      (SELECT item_id, w, least({options.width}, len(w)) AS width FROM item_words WHERE len(w) > 0))),
widths AS (SELECT DISTINCT width FROM item_windows),
doc_windows AS (SELECT doc_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS gram FROM
    (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, widths)),
found AS (SELECT doc_id, i, width, item_id FROM doc_windows JOIN item_windows USING (width, gram)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM
    (SELECT doc_id, unnest(range(i, i + width)) AS spot FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
    (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY doc_id)
SELECT doc_words.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
