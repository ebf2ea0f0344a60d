"""Mixing sources to target weights by proportionate-fair scheduling.

Each source is a chain of blocks. With weight w, its j-th block (from 0) is released at slot floor(j / w) and due by
slot ceil((j + 1) / w). Every slot goes to the released block with the earliest deadline, which keeps each source less
than one block from its share at all times. Weights are exact: floating-point numbers are whole multiples of one small
unit, so releases and deadlines are taken in whole numbers. Slots follow one another, so one task lays the schedule out,
a row for each block; it holds a few numbers for each source, whatever the number of blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch

# Up to so many sources their sizes are broadcast; more meet the documents in a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 64


@dataclass(frozen=True)
class MixOptions:
    """``weights`` by source; where it is None, a source weighs its size to the power ``exponent``. Sizes are
    characters plus one a document; a block is ``block`` of them. ``period`` is how many slots of the schedule are
    held at once; the schedule does not depend on it."""

    weights: Mapping[str, float] | None = None
    exponent: float = 0.5
    block: int = 1 << 16
    period: int = 1 << 10


@dataclass
class Phase:
    """A stretch of slots in which the same sources still have blocks."""

    start: int
    length: int


def _slots(units: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """First slot of the phase, source and block number of each slot. Sources are numbers, by falling ``units``.

    A phase ends when a source is used up. In the next all others begin anew at its first slot, where the one with the
    largest weight has the earliest deadline. So sources without a block in the phase stay in their order, and only
    those with one are in the heaps: no phase costs more than its slots.
    """
    total, size = sum(units), len(units)
    used, following = [0] * size, list(range(size + 1))

    def alive(source: int) -> int:
        """The first source from this one on that is not used up."""
        found = source
        while following[found] != found:
            found = following[found]
        while following[source] != found:
            following[source], source = found, following[source]
        return found

    start = slot = 0
    ready: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []
    fresh = alive(0)
    while total:
        now = slot - start
        while waiting and waiting[0][0] <= now:
            _, source, number = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(number + 1) * total // units[source]), source, number))
        first = (-(-total // units[fresh]), fresh, 0) if fresh < size else None
        if first and (not ready or first < ready[0]):
            fresh = alive(fresh + 1)
        elif ready:
            first = heapq.heappop(ready)
        else:
            raise RuntimeError("a slot without a released block")
        deadline, source, number = first
        if now >= deadline:
            raise RuntimeError("a block missed its deadline")
        yield start, source, used[source]
        used[source] += 1
        slot += 1
        if used[source] < blocks[source]:
            heapq.heappush(waiting, ((number + 1) * total // units[source], source, number + 1))
        else:
            total -= units[source]
            following[source] = source + 1
            start, ready, waiting, fresh = slot, [], [], alive(0)


def laid_out(blocks: Mapping, weights: Mapping, period: int) -> Iterator[list[tuple]]:
    """Lists of at most ``period`` slots: first slot of the phase, slot, source and block number, until every source is
    used up. When one is, the others share its part from the next slot on. Ties go to the source with the larger
    weight, then by name. Sources of weight 0 come after all others, in equal parts."""
    exact = {source: Fraction(weights[source]) for source, count in blocks.items() if count}
    if any(weight < 0 for weight in exact.values()):
        raise ValueError("a weight below 0")
    scale = math.lcm(*(weight.denominator for weight in exact.values()))
    units = {source: int(weight * scale) for source, weight in exact.items()}
    order = sorted(units, key=lambda source: (-units[source], str(source), source is None))
    held: list[tuple] = []
    before = 0
    for part in ([name for name in order if units[name]], [name for name in order if not units[name]]):
        slot = before
        for start, source, number in _slots([units[name] or 1 for name in part], [blocks[name] for name in part]):
            held.append((before + start, slot, part[source], number))
            slot += 1
            if len(held) >= period:
                yield held
                held = []
        before = slot
    if held:
        yield held


def phases(blocks: Mapping, weights: Mapping, period: int) -> list[Phase]:
    """The phases of the schedule."""
    found: list[Phase] = []
    for piece in laid_out(blocks, weights, period):
        for start, _, _, _ in piece:
            if not found or found[-1].start != start:
                found.append(Phase(start, 0))
            found[-1].length += 1
    return found


SLOTS = "slot_source string, slot_block long, slot long"


def _laying(period: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, weights = {}, {}
        for batch in batches:
            names = batch.column("source").to_pylist()
            blocks.update(zip(names, batch.column("blocks").to_pylist()))
            weights.update(zip(names, batch.column("weight").to_pylist()))
        for piece in laid_out(blocks, weights, period):
            _, slots, names, numbers = zip(*piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(slots, pa.int64())],
                ["slot_source", "slot_block", "slot"],
            )

    return task


def mixed(docs: DataFrame, options: MixOptions | None = None, source: str = "source") -> DataFrame:
    """Each row of ``docs`` as ``doc_id``, ``source``, its ``block`` number within the source, the ``slot`` of that
    block in the mix, and ``place``, its rank within the block. Reading by ``slot``, then ``place`` gives the mix.

    No row is dropped or repeated: a source that is used up leaves the mix, the others keep their proportions.
    Documents of a source are taken in the order of a hash of their id; a block is a run of about ``block``
    characters, so a document longer than a block takes the slot of the block it begins in and counts for those it
    fills. Running sizes are taken within hash ranges of about a block and over range totals, so a source with a third
    of all rows is not sorted in one task.

    Cases: a null or empty text has size 1; a null source is a source of its own; a source without a given weight is
    an error; rows with equal ids, null ids among them, keep a fixed order by text; an empty table gives no rows.
    """
    options = options or MixOptions()
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    narrow = docs.select(
        F.col("doc_id"),
        F.col(source).cast("string").alias("source"),
        (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), F.lit(17)).alias("order"),
        F.xxhash64("text").alias("tie"),
    )
    narrow = scratch.write(narrow, "documents")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("size"))
    if options.weights is None:
        weighed = totals.withColumn("weight", F.pow("size", F.lit(options.exponent)))
    else:
        rows = [(name, float(weight)) for name, weight in options.weights.items()]
        given = spark.createDataFrame(rows, "given_source string, weight double")
        weighed = totals.join(given, F.col("source").eqNullSafe(F.col("given_source")), "left")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / options.block)).cast("long")
    per_source = scratch.write(weighed.select("source", blocks.alias("blocks"), "weight"), "sources")
    lacking = per_source.filter("weight is null").first()
    if lacking:
        raise KeyError(lacking["source"])
    # One task for all sources: a slot depends on those before it.
    schedule = scratch.write(per_source.coalesce(1).mapInArrow(_laying(options.period), SLOTS), "schedule")
    # As many hash ranges as blocks: a range holds about a block's documents.
    known = per_source.select(F.col("source").alias("source_of"), "blocks")
    same_source = F.col("source").eqNullSafe(F.col("source_of"))
    if known.count() <= BROADCAST_SOURCES:
        joined = narrow.join(F.broadcast(known), same_source)
    else:
        salted = known.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = narrow.withColumn("salt", F.pmod("order", F.lit(SALTS)).cast("int")).join(
            salted, same_source & (F.col("salt") == F.col("salt_of"))
        )
    ranged = joined.withColumn(
        "range", F.floor((F.shiftrightunsigned("order", 32) * F.col("blocks")) / F.lit(float(1 << 32))).cast("long")
    )
    in_range = Window.partitionBy("source", "range").orderBy("order", "doc_id", "tie")
    inner = ranged.select(
        "doc_id", "source", "blocks", "range", "order", "tie",
        F.coalesce(F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    per_range = ranged.groupBy("source", "range").agg(F.sum("size").alias("size"))
    # Totals of ranges in two steps, so that no task orders all ranges of a large source.
    group = F.floor(F.col("range") / 4096)
    per_range = per_range.withColumn("group", group)
    groups = per_range.groupBy("source", "group").agg(F.sum("size").alias("size"))
    over_groups = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        F.col("source").alias("group_source"), F.col("group").alias("group_of"),
        F.coalesce(F.sum("size").over(over_groups), F.lit(0)).alias("group_before"),
    )
    over_ranges = Window.partitionBy("source", "group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_range.withColumn("range_before", F.coalesce(F.sum("size").over(over_ranges), F.lit(0)))
        .join(groups, F.col("source").eqNullSafe(F.col("group_source")) & (F.col("group") == F.col("group_of")))
        .select(
            F.col("source").alias("start_source"), F.col("range").alias("start_range"),
            (F.col("range_before") + F.col("group_before")).alias("start"),
        )
    )
    placed = inner.join(
        starts, F.col("source").eqNullSafe(F.col("start_source")) & (F.col("range") == F.col("start_range"))
    ).withColumn("offset", F.col("start") + F.col("before"))
    block = F.least(F.floor(F.col("offset") / options.block), F.col("blocks") - 1).cast("long")
    placed = placed.select("doc_id", "source", block.alias("block"), "offset", "order", "tie")
    found = placed.join(
        schedule, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("block") == F.col("slot_block"))
    )
    in_block = Window.partitionBy("source", "block").orderBy("offset", "order", "doc_id", "tie")
    return found.select("doc_id", "source", "block", "slot", F.row_number().over(in_block).cast("long").alias("place"))
