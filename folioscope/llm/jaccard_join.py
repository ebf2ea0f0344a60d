"""N-gram Jaccard join: which documents share most of their word n-grams, and which groups that makes.

The join is size-aware. Small sets enumerate all two-element subsets of their prefix, so only sets that share a whole
subset meet; large sets post single elements to inverted lists, which are scanned. A cost estimate from the corpus
sets the boundary. Both are exact: with the elements of every set in one global order (rare before frequent), two sets
of n and m elements that share at least ceil(t * max(n, m)) elements share one of the first n - ceil(t * n) + 1 of
either, and two of the first n - ceil(t * n) + 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.scratch import Scratch, arrow_rows, batches_of
from folioscope.llm.words import mix, shingle_sets

# A set's sketch has this many bits; see ``apart``.
SKETCH_BITS = 1024
# Documents to fetch are marked in a bit table of this size (8 MB), whatever their number. Chance hits only fetch more.
MARK_BITS = 1 << 26
# Lists are compared in squares of this many documents, so no task holds a longer list.
BLOCK = 1024
# Rows of a batch that is sent to the Python workers: sets and texts are wide.
BATCH_ROWS = 1_000


@dataclass(frozen=True)
class JoinOptions:
    """``width`` words make a shingle; two sets link from ``percent`` percent of their union on.

    ``frequent_limit`` bounds the broadcast table of frequent shingles (12 bytes each). The order of shingles is
    exact above the frequency that the bound leaves, and by hash below. ``hubs`` documents per list are tried as
    centres before what is left is compared pairwise.
    """

    width: int = 5
    percent: int = 80
    frequent_limit: int = 1 << 20
    hubs: int = 8


def sketches(elements: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bit set of each set, a row each: an element sets one bit."""
    bits = np.zeros((len(edges) - 1, SKETCH_BITS), np.uint8)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    bits[owner, (elements >> np.uint64(54)).astype(np.int64) & (SKETCH_BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def digests(elements: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; 0 for an empty one."""
    one, two = np.zeros(len(edges) - 1, np.uint64), np.zeros(len(edges) - 1, np.uint64)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        one[some] = np.bitwise_xor.reduceat(mix(elements ^ np.uint64(0x9E3779B97F4A7C15)), edges[some])
        two[some] = np.add.reduceat(mix(elements), edges[some])
    return one.view(np.int64), two.view(np.int64)


def _described(width: int):
    """Size, digest and sketch of the set of each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                elements, edges = shingle_sets(batch.column("text"), width)
                one, two = digests(elements, edges)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(edges)),
                        pa.array(one),
                        pa.array(two),
                        pa.array([row.tobytes() for row in sketches(elements, edges)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest_one", "digest_two", "sketch"],
                )

    return task


def short_name(elements: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 further bits of an element. Elements of one short name count and meet as one, which costs
    candidates but no result."""
    bucket = (elements >> np.uint64(64 - bucket_bits)).astype(np.int64)
    rest = ((elements << np.uint64(bucket_bits)) >> np.uint64(32)).astype(np.uint32)
    return bucket, rest


def _cut(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The columns' bytes by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
    columns = [column[order] for column in columns]
    for begin, end in zip(first, np.append(first[1:], len(bucket))):
        yield int(bucket[begin]), [column[begin:end].tobytes() for column in columns]


def _counted(width: int, bucket_bits: int, most: int = 1 << 20):
    """Per task and bucket: the short names of its shingles and in how many documents each occurs."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        names, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = (names >> np.uint64(32)).astype(np.int64)
        rest = names.astype(np.uint32)
        rows = [
            (key, name, count)
            for key, (name, count) in _cut(bucket, [rest, np.minimum(counts, 65535).astype(np.uint16)])
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row[0] for row in rows], pa.int64()),
                pa.array([row[1] for row in rows], pa.binary()),
                pa.array([row[2] for row in rows], pa.binary()),
            ],
            ["bucket", "names", "counts"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in batches_of(whole, "text"):
                found, _ = shingle_sets(batch.column("text"), width)
                bucket, rest = short_name(found, bucket_bits)
                held.append((bucket.astype(np.uint64) << np.uint64(32)) | rest)
                size += len(found)
                if size >= most:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return task


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint32)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint16)
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[first], np.add.reduceat(counts.astype(np.int64), first)


def _frequent(least: int):
    def task(table: pa.Table) -> pa.Table:
        names, counts = _summed(table)
        bucket = table.column("bucket")[0].as_py()
        chosen = counts >= least
        return pa.table(
            {
                "name": pa.array((bucket << 32) | names[chosen].astype(np.int64), pa.int64()),
                "frequency": pa.array(counts[chosen], pa.int64()),
            }
        )

    return task


def frequent_shingles(
    docs: DataFrame, options: JoinOptions, bucket_bits: int, scratch: Scratch
) -> tuple[np.ndarray, np.ndarray, float]:
    """Short names and frequencies of the most frequent shingles, at most ``frequent_limit``, sorted by name; and
    the mean length of the list that a remaining repeated shingle would have."""
    counted = docs.select("doc_id", "text").mapInArrow(
        _counted(options.width, bucket_bits), "bucket long, names binary, counts binary"
    )
    repeated = scratch.write(
        counted.groupBy("bucket").applyInArrow(_frequent(2), "name long, frequency long"), "repeated"
    )
    by_size = (
        repeated.groupBy(F.floor(F.log2("frequency") * 4).alias("step"))
        .agg(F.count("*").alias("rows"), F.min("frequency").alias("least"), F.sum("frequency").alias("entries"))
        .collect()
    )
    total, least, rest = 0, None, []
    for row in sorted(by_size, key=lambda row: -row["step"]):
        if total + row["rows"] > options.frequent_limit:
            rest = [other for other in by_size if other["step"] <= row["step"]]
            break
        total, least = total + row["rows"], row["least"]
    mean = sum(row["entries"] for row in rest) / max(1, sum(row["rows"] for row in rest)) if rest else 1.0
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), mean
    table = repeated.filter(F.col("frequency") >= least).toArrow()
    names = table.column("name").to_numpy().astype(np.uint64)
    order = np.argsort(names)
    names, frequency = names[order], table.column("frequency").to_numpy()[order]
    scratch.drop(repeated)
    return names, frequency, mean


def boundary(mean_list: float, options: JoinOptions) -> int:
    """Largest set that enumerates subsets: its subsets must cost no more entries than scanning its lists."""
    size = 0
    for candidate in range(4, 400):
        prefix = candidate - -(-candidate * options.percent // 100) + 1
        if (prefix + 1) * prefix // 2 <= prefix * (1 + mean_list):
            size = candidate
    return size


class Frequent:
    """Frequencies of the frequent shingles by short name; 0 for others. A table of marks answers most questions."""

    def __init__(self, names: np.ndarray, frequency: np.ndarray, bucket_bits: int) -> None:
        self.names, self.frequency, self.bits = names, frequency, bucket_bits
        self.marks = np.zeros(1 << 22, bool)
        self.marks[self._mark(names)] = True

    def _mark(self, names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(max(0, 32 + self.bits - 22))).astype(np.int64) & ((1 << 22) - 1)

    def weight(self, elements: np.ndarray) -> np.ndarray:
        bucket, rest = short_name(elements, self.bits)
        short = (bucket.astype(np.uint64) << np.uint64(32)) | rest
        weight = np.zeros(len(elements), np.int64)
        asked = np.flatnonzero(self.marks[self._mark(short)])
        if len(asked):
            place = np.minimum(np.searchsorted(self.names, short[asked]), len(self.names) - 1)
            weight[asked] = np.where(self.names[place] == short[asked], self.frequency[place], 0)
        return weight


def signatures(
    found: np.ndarray, weight: np.ndarray, edge: int, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set, the place of the last element of each in the set's order, and whether all its elements
    are frequent ones. ``weight`` has the frequencies, 0 for elements that are not frequent."""
    size = len(found)
    if size < 4 and percent >= 80:  # can only be equal to another set
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    prefix = size - -(-size * percent // 100) + 1
    rare = np.flatnonzero(weight == 0)[: prefix + 1]
    order = rare if len(rare) > prefix else np.lexsort((found, weight))[: prefix + 1]
    ordered, known = found[order], weight[order] > 0
    alone = size > edge or size * 100 >= percent * (edge + 1)
    made = [mix(ordered[:prefix])] if alone else []
    places = [np.arange(prefix)] if alone else []
    heavy = [known[:prefix]] if alone else []
    if size <= edge:
        one, two = np.triu_indices(min(prefix + 1, size), 1)
        made.append(mix(ordered[one] * np.uint64(3) + mix(ordered[two])) ^ np.uint64(1))
        places.append(two)
        heavy.append(known[one] & known[two])
    return np.concatenate(made), np.concatenate(places), np.concatenate(heavy)


def _posted(options: JoinOptions, shared, bucket_bits: int, edge: int, most: int = 1 << 18):
    """Per task and bucket: signature, set, size and place of each posting. A set is named by its digest, and a task
    posts a set once, however many copies it reads. Signatures of frequent shingles, whose lists have no bound, do not
    meet in a bucket: they are dealt out by set, under negative numbers."""

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        signature, doc, size, place, heavy = (np.concatenate(column) for column in zip(*held))
        bucket, rest = short_name(signature, bucket_bits)
        name = (bucket.astype(np.uint64) << np.uint64(32)) | rest
        dealt = (mix(doc.view(np.uint64)) >> np.uint64(64 - bucket_bits)).astype(np.int64)
        rows = list(_cut(np.where(heavy, -1 - dealt, bucket), [name, doc, size, place]))
        return pa.RecordBatch.from_arrays(
            [pa.array([row[0] for row in rows], pa.int64())]
            + [
                pa.array([_halved(row[1][n]) if n == 0 and row[0] >= 0 else row[1][n] for row in rows], pa.binary())
                for n in range(4)
            ],
            ["bucket", "signatures", "docs", "sizes", "places"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(*shared.value, bucket_bits)
        held, count, seen = [], 0, set()
        for whole in batches:
            for batch in batches_of(whole, "text"):
                elements, edges = shingle_sets(batch.column("text"), options.width)
                names, _ = digests(elements, edges)
                weights = frequent.weight(elements)
                for doc, begin, end in zip(names.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                    if doc in seen:
                        continue
                    seen.add(doc)
                    signature, place, heavy = signatures(
                        elements[begin:end], weights[begin:end], edge, options.percent
                    )
                    posted = len(signature)
                    if posted:
                        doc_of = np.full(posted, doc, np.int64)
                        size_of = np.full(posted, end - begin, np.int32)
                        held.append([signature, doc_of, size_of, place.astype(np.int32), heavy])
                        count += posted
                if count >= most:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return task


def _halved(names: bytes) -> bytes:
    """The bucket's number is known, so its signatures need their last 32 bits only."""
    return np.frombuffer(names, np.uint64).astype(np.uint32).tobytes()


def _listed(table: pa.Table) -> pa.Table:
    """Postings of signatures that more than one set has, and all postings of frequent ones."""
    bucket = table.column("bucket")[0].as_py()
    signature = np.frombuffer(b"".join(table.column("signatures").to_pylist()), np.uint32 if bucket >= 0 else np.uint64)
    doc = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64)
    size = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.int32)
    place = np.frombuffer(b"".join(table.column("places").to_pylist()), np.int32)
    name = signature.astype(np.int64)
    if bucket >= 0:
        order = np.lexsort((doc, signature))
        name = name[order] | (bucket << 32)
        other = doc[order][1:] != doc[order][:-1]
        same = name[1:] == name[:-1]
        # Rows of a signature with one set only go; of a set that several tasks posted, one row stays.
        first = np.flatnonzero(np.append(True, ~same))
        sets = np.add.reduceat(np.append(True, ~same | other).astype(np.int64), first)
        shared = np.repeat(sets > 1, np.diff(np.append(first, len(name))))
        kept = shared & np.append(True, ~same | other)
        name, order = name[kept], order[kept]
    else:
        order = np.arange(len(name))
    return pa.table(
        {
            "signature": pa.array(name, pa.int64()),
            "name": pa.array(doc[order]),
            "size": pa.array(size[order]),
            "place": pa.array(place[order]),
        }
    )


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).sum(axis=-1, dtype=np.int32)


def may_link(left: dict, right: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may link, and a bound on their distance. The sides' arrays match or broadcast.

    Length: the smaller set must have enough elements. Place: if the list's signature is their first common one,
    what follows must be enough; a pair that links passes in the list of its first common signature. Sketch: two sets
    differ in at least as many elements as their sketches differ in bits.
    """
    one, two = left["size"].astype(np.int64), right["size"].astype(np.int64)
    needed = -(-(one + two) * percent // (100 + percent))
    fits = np.minimum(one, two) * 100 >= np.maximum(one, two) * percent
    fits &= np.minimum(one - left["place"], two - right["place"]) + 1 >= needed
    apart = popcount(left["sketch"] ^ right["sketch"])
    fits &= one + two - apart >= 2 * needed
    fits &= left["doc"] != right["doc"]
    return fits, apart


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Chunks of a sorted partition that end where a run of equal keys does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(batch.column(k)[0] != held[-1].column(k)[held[-1].num_rows - 1] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        changes = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            changes |= column[1:] != column[:-1]
        last = int(np.flatnonzero(changes)[-1]) + 1 if changes.any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    def sketch(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)

    return {
        name: sketch(table.column(name)) if name == "sketch" else table.column(name).to_numpy()
        for name in table.column_names
    }


def _rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict]:
    """Runs of equal keys of a sorted partition, as arrays; only runs of several rows and components."""
    for table in _whole_runs(batches, keys):
        columns = _columns(table)
        changes = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            changes |= columns[key][1:] != columns[key][:-1]
        first = np.flatnonzero(np.append(True, changes))
        least = np.minimum.reduceat(columns["component"], first)
        apart = np.flatnonzero(least != np.maximum.reduceat(columns["component"], first))
        ends = np.append(first[1:], table.num_rows)
        for begin, end in zip(first[apart].tolist(), ends[apart].tolist()):
            yield {name: column[begin:end] for name, column in columns.items()}


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    one, two = (np.concatenate(side) for side in zip(*found))
    pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _stars(percent: int, hubs: int, salt: int):
    """Each document of a list with the nearest of a few hubs of the list that are in another component.

    Hubs are the documents with the smallest hash of their id, one a component, so lists with much the same documents
    choose the same hubs. All lists of a chunk are compared at once, hub by hub.
    """

    def nearest(rows: dict) -> pa.RecordBatch:
        count = len(rows["doc"])
        run = np.cumsum(np.append(True, (np.diff(rows["signature"]) != 0) | (np.diff(rows["part"]) != 0))) - 1
        rank = mix(rows["doc"].view(np.uint64) + np.uint64(salt))
        by_component = np.lexsort((rank, rows["component"], run))
        first = np.append(True, (np.diff(run[by_component]) != 0) | (np.diff(rows["component"][by_component]) != 0))
        chosen = by_component[first]
        chosen = chosen[np.lexsort((rank[chosen], run[chosen]))]
        begin = np.searchsorted(run[chosen], np.arange(run[-1] + 1))
        length = np.diff(np.append(begin, len(chosen)))
        best = np.full(count, SKETCH_BITS + 1, np.int32)
        hub_of = np.zeros(count, np.int64)
        for number in range(hubs):
            asked = np.flatnonzero(number < length[run])
            hub = chosen[begin[run[asked]] + number]
            other = rows["component"][asked] != rows["component"][hub]
            asked, hub = asked[other], hub[other]
            if not len(asked):
                continue
            fits, apart = may_link(
                {name: column[asked] for name, column in rows.items()},
                {name: column[hub] for name, column in rows.items()},
                percent,
            )
            better = fits & (apart < best[asked])
            best[asked[better]] = apart[better]
            hub_of[asked[better]] = rows["doc"][hub[better]]
        some = best <= SKETCH_BITS
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["doc"][some]), pa.array(hub_of[some]), pa.array(best[some])], ["doc", "hub", "apart"]
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches, ["signature", "part"]):
            yield nearest(_columns(table))

    return task


def _squares(percent: int):
    """All pairs of two blocks of one list that are in different components and may link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for run in _rows(batches, ["signature", "one", "two"]):
            alone = run["one"][0] == run["two"][0]
            left = np.flatnonzero(run["block"] == run["one"])
            right = left if alone else np.flatnonzero(run["block"] == run["two"])
            for begin in range(0, len(left), 128):
                some = {name: column[left[begin : begin + 128]][:, None] for name, column in run.items()}
                other = {name: column[right][None] for name, column in run.items()}
                fits, apart = may_link(some, other, percent)
                fits &= some["component"] != other["component"]
                if alone:
                    fits &= some["doc"] < other["doc"]
                row, column = np.nonzero(fits)
                if len(row):
                    found.append((some["doc"][row, 0], other["doc"][0, column]))
                    count += len(row)
                if count > 50_000:
                    yield _pairs(found)
                    found, count = [], 0
        if found:
            yield _pairs(found)

    return task


def _set_rows(width: int, shared):
    """The sets of marked documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for whole in batches:
            spot = whole.column("spot").to_numpy()
            chosen = (marks[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)
            for batch in batches_of(whole.filter(pa.array(chosen.astype(bool))), "text"):
                elements, edges = shingle_sets(batch.column("text"), width)
                sets = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["doc", "elements"])

    return task


def _marks(ids: DataFrame) -> np.ndarray:
    """Bit table of hashed ids."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    words = (
        ids.select(spot.alias("spot"))
        .groupBy(F.expr("shiftright(spot, 6)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    marks = np.zeros(MARK_BITS // 64, np.uint64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return marks


def links_among(
    pairs: DataFrame, docs: DataFrame, known: list[DataFrame], options: JoinOptions, scratch: Scratch
) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets really are similar enough, by their whole sets.

    ``known`` are the sets that earlier calls wrote; those that are missing are added to it.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    for sets in known:
        ids = ids.join(sets.select(F.col("doc").alias("doc_id")), "doc_id", "left_anti")
    # Texts stay where they are read: the ids to fetch are sent to them as marks, and only sets move.
    marks = docs.sparkSession.sparkContext.broadcast(_marks(ids))
    spotted = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)).alias("spot"))
    # Hashes do not compress; trying to only costs buffers outside the heap.
    sets = spotted.mapInArrow(_set_rows(options.width, marks), "doc long, elements array<bigint>")
    known.append(scratch.write(sets, "sets", "none"))
    sets = known[0]
    for more in known[1:]:
        sets = sets.unionAll(more)
    joined = pairs.join(sets.select(F.col("doc").alias("a"), F.col("elements").alias("left")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("elements").alias("right")), "b"
    )
    common = F.size(F.array_intersect("left", "right"))
    total = F.size("left") + F.size("right")
    verified = joined.withColumn("common", common).filter(
        100 * F.col("common") >= options.percent * (total - F.col("common"))
    )
    return scratch.write(verified.select("a", "b"), "verified")


def similar_groups(docs: DataFrame, options: JoinOptions | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``class_id`` (smallest id with the same set), ``component_id``
    (smallest id that links reach).

    Equal sets are one class, and one document stands for it, so copies are never paired. Documents that share a
    signature are compared with a few hubs of their list first; what that joins needs no further comparison. All
    pairs of a list that are still in different components are then compared in blocks, so no link between different
    sets that could change a component is lost. A pair is only emitted if its sketches allow a link, and each is
    verified on whole sets.

    Cases: a null or wordless text has no shingles and links with nothing (``component_id`` is its own id); a text of
    fewer words than ``width`` is one shingle; rows that repeat an id give a row each and share the component; a row
    without id has null class and component; an empty table gives no rows. Other columns are ignored.
    """
    options = options or JoinOptions()
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _similar_groups(docs, options, Scratch(docs.sparkSession, "jaccard"))


def _similar_groups(docs: DataFrame, options: JoinOptions, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = scratch.write(
        docs.mapInArrow(
            _described(options.width),
            "doc_id long, n_shingles long, digest_one long, digest_two long, sketch binary",
        ),
        "described",
    )
    key = ["n_shingles", "digest_one", "digest_two"]
    named = described.filter("doc_id is not null and n_shingles > 0")
    # The smallest id stands for a class; the sketch is equal in all of it.
    classes = scratch.write(
        named.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch")), "classes"
    )
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    bucket_bits = max(4, min(24, int(total >> 19).bit_length()))
    with_id = docs.filter("doc_id is not null")
    names, frequency, mean = frequent_shingles(with_id, options, bucket_bits, scratch)
    shared = spark.sparkContext.broadcast((names, frequency))
    edge = boundary(mean, options)
    posted = with_id.mapInArrow(
        _posted(options, shared, bucket_bits, edge),
        "bucket long, signatures binary, docs binary, sizes binary, places binary",
    )
    listed = posted.groupBy("bucket").applyInArrow(_listed, "signature long, name long, size int, place int")
    listed = scratch.write(listed.dropDuplicates(["signature", "name", "size"]), "lists")
    long_enough = listed.groupBy("signature").agg(F.count("*").alias("length")).filter("length > 1")
    members = classes.select(
        F.col("digest_one").alias("name"), F.col("n_shingles").cast("int").alias("size"), F.col("class_id").alias("doc")
    )
    # Sketches join a list only where it is compared; the written lists are narrow.
    sketched = classes.select(F.col("class_id").alias("doc"), "sketch")
    lists = scratch.write(
        listed.join(long_enough, "signature")
        .join(members, ["name", "size"])
        .drop("name")
        .withColumn("component", F.col("doc")),
        "candidates",
    )
    scratch.drop(listed)
    # Hubs first, twice: in a quarter of the lists, as similar sets share many, then in all that are still apart.
    found, sets = None, []
    current = lists.filter(F.pmod(F.xxhash64("signature"), F.lit(4)) == 0)
    for turn in range(2):
        part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("length") / (8 * BLOCK)).cast("long"))
        stars = (
            current.withColumn("part", part)
            .join(sketched, "doc")
            .repartition("signature", "part")
            .sortWithinPartitions("signature", "part")
            .mapInArrow(_stars(options.percent, options.hubs, 7919 * turn), "doc long, hub long, apart int")
        )
        # The nearest hub of each document, over all its lists.
        chosen = stars.groupBy("doc").agg(F.min_by("hub", F.struct("apart", "hub")).alias("hub"))
        chosen = chosen.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
        links = links_among(scratch.write(chosen, "chosen"), with_id, sets, options, scratch)
        found = links if found is None else scratch.write(found.unionAll(links), "links")
        labels = components(found, scratch)
        current = (
            lists.drop("component")
            .join(labels.withColumnRenamed("node", "doc"), "doc", "left")
            .withColumn("component", F.coalesce("component", "doc"))
        )
        # Lists whose documents are all connected have nothing left to find.
        apart = (
            current.groupBy("signature")
            .agg(F.min("component").alias("one"), F.max("component").alias("two"))
            .filter("one < two")
            .select("signature")
        )
        current = scratch.write(current.join(apart, "signature", "left_semi"), "apart")
    blocks = F.ceil(F.col("length") / BLOCK).cast("long")
    block = F.pmod(F.xxhash64("doc"), blocks)
    squares = (
        current.join(sketched, "doc")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("one", F.least("block", "other"))
        .withColumn("two", F.greatest("block", "other"))
        .repartition("signature", "one", "two")
        .sortWithinPartitions("signature", "one", "two")
        .mapInArrow(_squares(options.percent), "a long, b long")
    )
    rest = links_among(scratch.write(squares.distinct(), "rest"), with_id, sets, options, scratch)
    labels = components(scratch.write(found.unionAll(rest), "links"), scratch)
    scratch.drop(lists, current, *sets)
    grouped = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        *key, "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    return (
        described.join(grouped, key, "left")
        .withColumn("mine", F.col("doc_id").isNotNull())
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("mine"), F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.when(F.col("mine"), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )
