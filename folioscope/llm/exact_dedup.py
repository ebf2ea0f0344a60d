"""Exact duplicates: a minimal perfect hash over the distinct digests of a history, looked up by every document.

The hash is kept in buckets of a few thousand digests. Each bucket has its hash (bit levels) and its slots: a slot holds
the full digest and the locator of the document that stays. A lookup finds one slot by the hash and compares all bytes of
the digest, so a document that is not in the history is never taken for one that is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch
from folioscope.llm.words import mix

SPACE = " \t\n\x0b\x0c\r"
# Digests a bucket holds on average.
BUCKET_KEYS = 8_192
# Rows of a bucket that one task looks up; a bucket with more is spread. At most rows / UNIT_ROWS buckets are, which
# bounds the table broadcast for them (12 bytes a row: 24 MB at 33 billion documents).
UNIT_ROWS = 16_384
# Bits a level has for each digest left.
ROOM = 1.5
DIGEST_BYTES = 32
CARRIED = ("row", "doc_id", "n_points", "group_size", "digest")
HASH, SLOT, ROW = 0, 1, 2


@dataclass(frozen=True)
class DigestIndex:
    """Minimal perfect hashes of a set of distinct digests.

    ``hashes``: ``bucket``, ``digest`` (the hash: sizes and bits of its levels). ``slots``: ``bucket``, ``slot`` and, of the
    document that stays, ``row``, ``doc_id``, ``n_points``, ``group_size`` and ``digest``.
    """

    hashes: DataFrame
    slots: DataFrame
    buckets: int


class PerfectHash:
    """Bits in levels: a digest alone at its place of a level has its bit set there, the others try the next level.

    The slot of a digest is the number of bits set before its own, so ``n`` digests fill the slots 0 to n - 1.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.starts = np.cumsum(sizes) - sizes
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = np.arange(len(keys)), [], []
        while len(left):
            size = max(1, math.ceil(ROOM * len(left)))
            at = cls._places(keys[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            sizes.append(size)
            levels.append(bits)
            left = left[~alone]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        # Levels take the four words of a digest in turn: two different digests part at the level of a word they differ in.
        word = mix(keys[:, level % 4] + np.uint64(level))
        return (word % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where no level has its bit. A digest outside the set may get any slot."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            at = start + self._places(keys[left], level, size)
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return found

    def packed(self) -> bytes:
        head = np.concatenate([[len(self.sizes)], self.sizes]).astype("<i8")
        return head.tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, body: bytes) -> PerfectHash:
        levels = int(np.frombuffer(body, "<i8", 1)[0])
        sizes = np.frombuffer(body, "<i8", levels, 8).astype(np.int64)
        bits = np.unpackbits(np.frombuffer(body, np.uint8, offset=8 * (levels + 1)), count=int(sizes.sum()))
        return cls(sizes, bits.astype(bool))


def digest_words(column: pa.Array) -> np.ndarray:
    """The four 64-bit words of each digest of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(body).view("<u8").reshape(-1, DIGEST_BYTES // 8)


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``row`` (a number for the row), ``doc_id``, ``n_points`` (code points of the text), ``group_size`` (1) and
    ``digest`` (SHA-256 of the text without white space) of every row. Write it before use: without a column for them the
    numbers are those of this plan."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        "doc_id",
        F.char_length(text).cast("long").alias("n_points"),
        F.lit(1).cast("long").alias("group_size"),
        F.unhex(F.sha2(F.translate(text, SPACE, ""), 256)).alias("digest"),
    )


def distinct_digests(seen: DataFrame) -> DataFrame:
    """One row for each digest: the row that stays (most code points, then smallest id, null last, then smallest row
    number) and the size of the group. Groups are combined before the shuffle."""
    best = F.min(F.struct((-F.col("n_points")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    groups = seen.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
    return groups.select("best.row", "best.doc_id", (-F.col("best.longest")).alias("n_points"), "group_size", "digest")


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def _build(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    keys = digest_words(group.column("digest").chunk(0))
    perfect = PerfectHash.of(keys)
    slots = group.append_column("slot", pa.array(perfect.slots(keys)))
    nothing = [pa.array([None], field.type) for field in group.schema if field.name not in ("bucket", "digest")]
    names = [name for name in group.column_names if name not in ("bucket", "digest")]
    whole = pa.table(
        [group.column("bucket").slice(0, 1), pa.array([perfect.packed()], pa.binary()), pa.array([-1]), *nothing],
        names=["bucket", "digest", "slot", *names],
    )
    return pa.concat_tables([whole.select(slots.column_names), slots])


def build_index(scratch: Scratch, groups: DataFrame) -> DigestIndex:
    """The index of a written table of distinct digests. A bucket has about ``BUCKET_KEYS`` of them, whatever their number."""
    buckets = max(1, math.ceil(groups.count() / BUCKET_KEYS))
    rows = _in_buckets(groups, buckets).select("bucket", *CARRIED)
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.schema) + ", slot long"
    built = scratch.write(rows.groupBy("bucket").applyInArrow(_build, schema), "index")
    return DigestIndex(
        built.filter("slot < 0").select("bucket", "digest"), built.filter("slot >= 0"), buckets
    )


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket: its hash, its slots, then the rows to look up. One bucket is in memory."""
    bucket, perfect, held, keys, slots = None, None, [], None, None
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        homes = batch.column("bucket").to_numpy(zero_copy_only=False)
        salts = batch.column("salt").to_numpy(zero_copy_only=False)
        new = np.flatnonzero((np.diff(homes) != 0) | (np.diff(salts) != 0) | (np.diff(kinds) != 0)) + 1
        for first, last in zip(np.r_[0, new].tolist(), np.r_[new, batch.num_rows].tolist()):
            part = batch.slice(first, last - first)
            if bucket != (homes[first], salts[first]):
                bucket, perfect, held, keys, slots = (homes[first], salts[first]), None, [], None, None
            if kinds[first] == HASH:
                perfect = PerfectHash.unpacked(part.column("digest")[0].as_py())
                continue
            if kinds[first] == SLOT:
                held.append(part)
                keys = None
                continue
            if keys is None and held:
                table = pa.Table.from_batches(held).sort_by("slot").combine_chunks()
                keys, slots = digest_words(table.column("digest").chunk(0)), table
            wanted = digest_words(part.column("digest"))
            slot = perfect.slots(wanted) if perfect is not None else np.full(len(wanted), -1, np.int64)
            # The byte check: the hash gives a digest outside the history some slot, its bytes tell them apart.
            known = slot >= 0
            if known.any():
                known[known] = (keys[slot[known]] == wanted[known]).all(axis=1)
            at = pa.array(np.where(known, slot, 0), mask=~known)
            found = [
                slots.column(name).combine_chunks().take(at) if slots is not None else pa.nulls(len(at), part.column(name).type)
                for name in ("row", "doc_id", "group_size")
            ]
            found = [column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column for column in found]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(name) for name in CARRIED), pa.array(known), *found],
                names=[*CARRIED, "known", "keep_row", "keep_id", "keep_size"],
            )


def lookup(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``rows`` (columns ``CARRIED``, a written table) with ``known`` (its digest is in the index, bytes compared) and the
    document that stays there: ``keep_row``, ``keep_id`` and ``keep_size``, null where unknown.

    Rows and slots meet by bucket and are streamed, so a task holds one bucket of slots. Rows of a bucket with many rows
    (a large group of copies) are spread over as many tasks as they need, each with a copy of the bucket.
    """
    placed = _in_buckets(rows.select(*CARRIED), index.buckets)
    hot = placed.groupBy("bucket").count().filter(F.col("count") > UNIT_ROWS)
    hot = hot.select("bucket", F.ceil(F.col("count") / UNIT_ROWS).cast("int").alias("units"))
    hot = F.broadcast(Scratch(rows.sparkSession, "lookup").write(hot, "hot"))
    salt = F.pmod(F.xxhash64("row"), F.coalesce("units", F.lit(1)))
    placed = placed.join(hot, "bucket", "left").select("bucket", salt.cast("int").alias("salt"), *CARRIED)

    def copies(part: DataFrame) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.coalesce("units", F.lit(1)) - 1))
        return part.join(hot, "bucket", "left").withColumn("salt", each).drop("units")

    empty = [F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in CARRIED if name != "digest"]
    hashes = copies(index.hashes).select("bucket", "salt", *empty, "digest", F.lit(-1).cast("long").alias("slot"))
    slots = copies(index.slots).select("bucket", "salt", *CARRIED, "slot")
    union = (
        hashes.withColumn("kind", F.lit(HASH))
        .unionByName(slots.withColumn("kind", F.lit(SLOT)))
        .unionByName(placed.withColumn("slot", F.lit(-1).cast("long")).withColumn("kind", F.lit(ROW)))
    )
    name = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {name}, n_points long, group_size long, digest binary, known boolean, keep_row long, "
        f"keep_id {name}, keep_size long"
    )
    met = union.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    return met.mapInArrow(_lookup, schema)


def history_index(docs: DataFrame) -> DigestIndex:
    """The index of the distinct digests of ``docs``, for later batches of documents."""
    scratch = Scratch(docs.sparkSession, "history")
    seen = scratch.write(digests(docs), "digests")
    return build_index(scratch, scratch.write(distinct_digests(seen), "distinct"))


def _decided(scratch: Scratch, seen: DataFrame, history: DigestIndex | None) -> DataFrame:
    groups = scratch.write(distinct_digests(seen), "distinct")
    if history is not None:
        # Row -1 is no row of the documents: where the history has the text, none of them stays.
        looked = lookup(groups, history).select(
            F.when(F.col("known"), F.lit(-1).cast("long")).otherwise(F.col("row")).alias("row"),
            F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("doc_id"),
            "n_points",
            (F.col("group_size") + F.coalesce("keep_size", F.lit(0))).alias("group_size"),
            "digest",
        )
        groups = scratch.write(looked, "merged")
    return lookup(seen, build_index(scratch, groups))


def exact_groups(docs: DataFrame, history: DigestIndex | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are after deleting white space (space and 0x09 to 0x0D). Of equal texts the row with most
    code points stays, then the smallest id. The table's own distinct digests are the history its rows are looked up in.
    With an earlier ``history`` its documents stay: a text found there is a repeat of the history's document and counts its
    copies there as well; all others are grouped among themselves.

    Cases: a null text is an empty one, and all texts without other characters are equal; a null id comes after all
    others; of rows equal in text, length and id one stays; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    found = _decided(scratch, scratch.write(digests(docs), "digests"), history)
    return found.select(
        "doc_id",
        "keep_id",
        F.col("keep_size").alias("group_size"),
        (F.col("keep_row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_repeats(docs: DataFrame, history: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Cases as in ``exact_groups``."""
    scratch = Scratch(docs.sparkSession, "kept")
    taken = {name.lower() for name in docs.columns}
    number = next("row_number" + "_" * n for n in range(99) if "row_number" + "_" * n not in taken)
    numbered = scratch.write(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = _decided(scratch, scratch.write(digests(numbered, number), "digests"), history)
    kept = found.filter("keep_row = row").select(F.col("row").alias(number))
    return numbered.join(kept, number, "left_semi").select(*(F.col(f"`{name}`") for name in docs.columns))


def oracle() -> str:
    """``exact_groups`` of ``documents`` in DuckDB SQL."""
    return """
WITH seen AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM documents),
ranked AS (SELECT doc_id, sha256(bare) AS text_sha256,
    first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY bare) AS group_size FROM seen)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""
