"""Exact substring deduplication with suffix arrays: every byte that lies in a long enough string occurring elsewhere.

1. Anchors. Each window of ``least`` bytes owns the smallest hashed ``GRAM``-byte string in it; equal windows own equal
   strings. Only anchors that occur twice or more can lie in a repeated window.
2. Shards. The text around those anchors goes to shards by anchor, so equal windows meet in a shard; an anchor that
   occurs very often is spread over several.
3. A suffix array per shard, by Larsson-Sadakane refinement in numpy: positions are ranked by their first 8 bytes,
   then groups of equal rank are refined by the rank that lies 8, 16, 32 ... bytes on. Kasai's walk gives the common
   prefix of neighbours, for all pieces of text in step. Neighbours with ``least`` bytes in common are repeats.
4. Shards that hold parts of one anchor are merged: each gives the sorted keys of its windows, and a window found in no
   other place of its own shard is looked up in the others by binary search.

Passages of fewer bytes stay in the text, but the words in them are counted (``n_passage_words``): windows of words own
anchors likewise, runs that are equal wherever their anchor stands repeat whole, and of the others each window is counted.
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
from folioscope.llm.words import BYTE_VALUES, NOT_SPACE, STEP, mix, plain_words, prefix_sums, spans_of, text_bytes

GRAM = 32
# Words whose hash may own a window of words, and windows that are judged at a time.
WORD_GRAM = 16
WORD_SEGMENT = 1 << 19
# Bytes of a block that common prefixes are counted by: eight, doubled three times.
BLOCK = 64


@dataclass(frozen=True)
class SuffixOptions:
    """``least`` bytes make a repeat. A shard gets about ``shard_bytes`` of text; an anchor with more than
    ``spread_from`` occurrences is spread over several shards. Texts are searched for anchors ``segment`` bytes at a
    time. ``passage`` words, ``WORD_GRAM`` at least, make a passage."""

    least: int = 400
    shard_bytes: int = 2 << 20
    spread_from: int = 2000
    segment: int = 1 << 19
    passage: int = 51


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hash of the ``width`` bytes from each position on, by doubling: two halves make a whole."""
    value = BYTE_VALUES[data]
    step, size = STEP, 1
    while size < width:
        value = value[:-size] + value[size:] * step if len(value) > size else value[:0]
        step = np.uint64(int(step) ** 2 & 0xFFFFFFFFFFFFFFFF)
        size *= 2
    return mix(value)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values: block-wise minima from the left and from the right."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:count], left[width - 1 : width - 1 + count])


def segments(offsets: np.ndarray, options: SuffixOptions) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, first byte, byte behind) of about a segment in all. A longer text is cut so that every window
    lies in one piece whole; texts too short for a window are left out."""
    held, size = [], 0
    for text, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for first in range(begin, end - options.least + 1, options.segment):
            behind = min(end, first + options.segment + options.least - 1)
            held.append((text, first, behind))
            size += behind - first
            if size >= options.segment:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(data: np.ndarray, parts: list[tuple[int, int, int]], least: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows that own equal anchors: part number, anchor, first and last window start in ``data``,
    and how often the anchor occurs in the run (a text of a short period repeats it in one run)."""
    joined = np.concatenate([data[first:behind] for _, first, behind in parts])
    sizes = np.array([behind - first for _, first, behind in parts])
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)
    shift = np.array([first for _, first, _ in parts]) - (ends - sizes)
    grams, span = gram_hashes(joined), least - GRAM + 1
    owned = sliding_least(grams, span)
    start = np.flatnonzero(np.arange(len(owned)) + least <= ends[part[: len(owned)]])
    value, of = owned[start], part[start]
    head = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])))
    tail = np.append(head[1:], len(start)) - 1
    # A position is an anchor if the largest least value of the windows around it is its own.
    around = np.zeros(len(owned) + 2 * (span - 1), np.uint64)
    around[start + span - 1] = value
    reach = ~sliding_least(~around, span)
    count = min(len(grams), len(reach))
    at = np.flatnonzero(grams[:count] == reach[:count])
    group = np.append(True, (grams[at][1:] != grams[at][:-1]) | (part[at][1:] != part[at][:-1]))
    times = np.bincount(np.cumsum(group) - 1, minlength=len(head))
    if len(times) != len(head):
        raise RuntimeError("anchors and runs do not match")
    return of[head], value[head], start[head] + shift[of[head]], start[tail] + shift[of[tail]], times


ANCHORS = "doc_id long, key long, anchor long, times long"


def _anchored(options: SuffixOptions):
    """The anchors of each document and how often it has them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                for parts in segments(offsets, options):
                    part, anchor, _, _, times = anchors(data, parts, options.least)
                    text = pa.array(np.array([row[0] for row in parts])[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(text),
                            batch.column("key").take(text),
                            pa.array(anchor.view(np.int64)),
                            pa.array(times.astype(np.int64)),
                        ],
                        ["doc_id", "key", "anchor", "times"],
                    )

    return task


PIECES = "doc_id long, key long, anchor long, total long, first long, last long, piece binary"


def _cut_pieces(options: SuffixOptions):
    """The text of the windows of each repeated anchor: from the first window's start to the last one's end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                known = [
                    {row["anchor"]: row["total"] for row in rows} for rows in batch.column("repeated").to_pylist()
                ]
                for parts in segments(offsets, options):
                    part, anchor, first, last, _ = anchors(data, parts, options.least)
                    anchor = anchor.view(np.int64).tolist()
                    text = [parts[place][0] for place in part.tolist()]
                    kept = [place for place, name in enumerate(anchor) if name in known[text[place]]]
                    owner = pa.array([text[place] for place in kept], pa.int64())
                    base = offsets[[text[place] for place in kept]] if kept else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(owner),
                            batch.column("key").take(owner),
                            pa.array([anchor[place] for place in kept], pa.int64()),
                            pa.array([known[text[place]][anchor[place]] for place in kept], pa.int64()),
                            pa.array(first[kept] - base, pa.int64()),
                            pa.array(last[kept] - base, pa.int64()),
                            pa.array(
                                [data[first[place] : last[place] + options.least].tobytes() for place in kept],
                                pa.binary(),
                            ),
                        ],
                        ["doc_id", "key", "anchor", "total", "first", "last", "piece"],
                    )

    return task


def suffix_array(data: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes of all pieces in order, the place of each in it, the eight bytes from each position on, and numbers that
    are equal where ``BLOCK`` bytes from a position on are (for positions with so many in their piece).

    A suffix ends with its piece; of two that are equal, the one of the earlier piece comes first. Positions are
    grouped by their first eight bytes; each round orders the groups that still have several members by the rank of
    what follows the part they share, which doubles that part.
    """
    count = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(count, np.uint64)
    end = ends[piece]
    for place in range(8):
        inside = np.arange(count) + place < end
        eight = (eight << np.uint64(8)) | np.where(inside, padded[place : place + count], np.uint64(0))
    order = np.argsort(eight)
    head = np.append(True, eight[order][1:] != eight[order][:-1])
    rank = np.empty(count, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(count), 0))
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    step, pieces, block = 8, len(ends), None
    while len(slots):
        if step == BLOCK:
            block = rank.copy()
        members = order[slots]
        behind = members + step
        over = behind >= end[members]
        second = np.where(over, piece[members], pieces + rank[np.minimum(behind, count - 1)])
        both = (rank[members].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        arranged = np.argsort(both)
        members, both = members[arranged], both[arranged]
        order[slots] = members
        head = np.append(True, both[1:] != both[:-1])
        rank[members] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        slots = slots[~(head & np.append(head[1:], True))]
        step *= 2
    # Where the groups came apart sooner, no two positions share a block.
    return order, rank, eight, rank if block is None else block


def common_prefixes(
    order: np.ndarray,
    rank: np.ndarray,
    eight: np.ndarray,
    block: np.ndarray,
    end: np.ndarray,
    starts: np.ndarray,
    stops: np.ndarray,
    enough: int,
) -> np.ndarray:
    """Kasai's walk: bytes, ``enough`` at most, that each suffix shares with the one before it in order, for starts up to
    stops (behind).

    From one position to the next the shared part loses one byte at most, so the walk never begins anew. Each run of
    positions is a lane, and all lanes take a step together: over equal blocks first, then by eight bytes. Other
    positions keep 0.
    """
    shared = np.zeros(len(order), np.int64)
    here, height = starts.copy(), np.zeros(len(starts), np.int64)
    stop = stops.copy()
    while len(here):
        before = np.where(rank[here] > 0, order[np.maximum(rank[here] - 1, 0)], -1)
        most = np.where(before >= 0, np.minimum(np.minimum(end[here] - here, end[before] - before), enough), 0)
        height = np.minimum(height, most)
        far = np.flatnonzero(height + BLOCK <= most)
        while len(far):
            far = far[block[here[far] + height[far]] == block[before[far] + height[far]]]
            height[far] += BLOCK
            far = far[height[far] + BLOCK <= most[far]]
        open_lanes = np.flatnonzero(height < most)
        while len(open_lanes):
            one = eight[here[open_lanes] + height[open_lanes]]
            two = eight[before[open_lanes] + height[open_lanes]]
            apart = one ^ two
            equal = np.full(len(open_lanes), 8)
            different = apart != 0
            # Leading equal bytes, from the place of the highest bit that differs. Without neighbouring bits the
            # value cannot be rounded up to the next power of two.
            highest = apart[different] & ~(apart[different] >> np.uint64(1))
            bits = np.frexp(highest.astype(np.float64))[1]
            equal[different] = (64 - bits) // 8
            height[open_lanes] = np.minimum(height[open_lanes] + equal, most[open_lanes])
            open_lanes = open_lanes[(equal == 8) & (height[open_lanes] < most[open_lanes])]
        shared[here] = height
        here, height = here + 1, np.maximum(height - 1, 0)
        going = here < stop
        if not going.all():
            here, height, stop = here[going], height[going], stop[going]
    return shared


def window_keys(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``width`` bytes from each position on, put together from powers of two."""
    count = len(data) - width + 1
    one, two, begin = np.zeros(count, np.uint64), np.zeros(count, np.uint64), 0
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            part = gram_hashes(data, 1 << bit)[begin : begin + count]
            one = mix(one * np.uint64(3) + part)
            two = mix(two * np.uint64(5) + (part ^ np.uint64(0x9E3779B97F4A7C15)))
            begin += 1 << bit
    return one, two


# Spans of bytes that repeat, or windows of spread anchors that are still to be looked up in other shards.
FOUND = "doc_id long, key long, start long, behind long, bucket long, shard long, known binary, unknown binary"
_FOUND = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "key", "start", "behind", "bucket", "shard")]
    + [("known", pa.binary()), ("unknown", pa.binary())]
)
_WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("row", "<i8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i8"), ("null", "<i8")])
# Windows of spread anchors that one task looks up.
MERGED = 1 << 20


def repeats_in(pieces: list[bytes], counts: np.ndarray, runs: np.ndarray, least: int):
    """Which windows of distinct pieces of text occur elsewhere among them: a flag per byte position of all pieces
    put together, with the pieces' ends and numbers. ``runs`` has the number of windows of each."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(piece) for piece in pieces])
    ends = np.cumsum(sizes)
    number = np.repeat(np.arange(len(pieces)), sizes)
    order, rank, eight, block = suffix_array(data, ends, number)
    begins = ends - sizes
    lanes = [np.arange(begin, begin + run, 512) for begin, run in zip(begins, runs)]
    starts = np.concatenate(lanes)
    stops = np.minimum(starts + 512, np.repeat(begins + runs, [len(lane) for lane in lanes]))
    shared = common_prefixes(order, rank, eight, block, ends[number], starts, stops, least)
    long_enough = shared[order] >= least
    repeated = np.zeros(len(data), bool)
    repeated[order] = long_enough | np.append(long_enough[1:], False)
    for place in np.flatnonzero(counts > 1):
        repeated[begins[place] : begins[place] + runs[place]] = True
    return data, begins, ends, number, repeated


def _spans(table: pa.Table, rows, at, behind) -> pa.Table:
    """Spans of bytes (``at`` up to ``behind``) in the texts that ``rows`` of a shard come from."""
    chosen = pa.array(rows, pa.int64())
    none = pa.nulls(len(chosen), pa.int64())
    return pa.table(
        [
            table.column("doc_id").take(chosen).combine_chunks(),
            table.column("key").take(chosen).combine_chunks(),
            pa.array(at, pa.int64()), pa.array(behind, pa.int64()), none, none,
            pa.nulls(len(chosen), pa.binary()), pa.nulls(len(chosen), pa.binary()),
        ],
        schema=_FOUND,
    )


def _shard(options: SuffixOptions, bucket_bits: int):
    """Spans of repeated windows in a shard. An anchor that has one piece of text, several times, needs no sorting: equal
    windows own equal anchors, so all its windows repeat, in these copies and nowhere else."""
    least = options.least

    def task(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        pieces = table.column("piece").to_pylist()
        first = table.column("first").to_numpy()
        run = table.column("last").to_numpy() - first + 1
        spread = table.column("total").to_numpy() > options.spread_from
        distinct: dict[bytes, int] = {}
        which = np.array([distinct.setdefault(piece, len(distinct)) for piece in pieces])
        counts = np.bincount(which)
        runs, of_anchor = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        runs[which], of_anchor[which] = run, table.column("anchor").to_numpy()
        shared = np.zeros(len(distinct), bool)
        shared[which[spread]] = True
        _, inverse, variants = np.unique(of_anchor, return_inverse=True, return_counts=True)
        copies = (variants[inverse] == 1) & (counts > 1) & ~shared
        # The pieces that are sorted, and rows and pieces by their number among them.
        chosen_pieces = np.flatnonzero(~copies)
        renumbered = np.full(len(distinct), -1)
        renumbered[chosen_pieces] = np.arange(len(chosen_pieces))
        copied = np.flatnonzero(copies[which])
        which = renumbered[which]
        names = list(distinct)
        if not len(chosen_pieces):
            return _spans(table, copied, first[copied], first[copied] + run[copied] - 1 + least)
        counts, runs = counts[chosen_pieces], runs[chosen_pieces]
        distinct = [names[place] for place in chosen_pieces]
        data, begins, ends, number, repeated = repeats_in(distinct, counts, runs, least)
        places = np.flatnonzero(repeated)
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + least, -1)
        inside = np.cumsum(change[:-1]) > 0
        edge = np.append(True, number[1:] != number[:-1])
        opens = np.flatnonzero(inside & (edge | ~np.append(False, inside[:-1])))
        closes = np.flatnonzero(inside & (np.append(edge[1:], True) | ~np.append(inside[1:], False))) + 1
        from_piece = np.searchsorted(number[opens], np.arange(len(distinct) + 1))
        rows, at = copied.tolist(), first[copied].tolist()
        behind = (first[copied] + run[copied] - 1 + least).tolist()
        for row, piece in enumerate(which.tolist()):
            for place in range(from_piece[piece], from_piece[piece + 1]) if piece >= 0 else ():
                rows.append(row)
                at.append(int(opens[place] - begins[piece] + first[row]))
                behind.append(int(closes[place] - begins[piece] + first[row]))
        spans = _spans(table, rows, at, behind)
        if not spread.any():
            return spans
        # Windows of anchors that other shards have too.
        wide = np.zeros(len(distinct), bool)
        wide[which[spread]] = True
        one, two = window_keys(data, least)
        owned = np.zeros(len(data), bool)
        for piece in np.flatnonzero(wide):
            owned[begins[piece] : begins[piece] + runs[piece]] = True
        owned = np.flatnonzero(owned[: len(one)])
        row_of = np.zeros(len(distinct), np.int64)
        row_of[which[which >= 0]] = np.flatnonzero(which >= 0)
        window = np.zeros(len(owned), _WINDOW)
        row = row_of[number[owned]]
        docs, keys = table.column("doc_id"), table.column("key").to_numpy()
        window["one"], window["two"] = one[owned], two[owned]
        window["doc"] = docs.fill_null(0).to_numpy()[row]
        window["null"] = docs.is_null().to_numpy()[row]
        window["key"], window["start"] = keys[row], owned - begins[number[owned]] + first[row]
        alone = ~repeated[owned]
        _, distinct_at = np.unique(window["one"], return_index=True)
        window_bucket = (window["one"] >> np.uint64(64 - bucket_bits)).astype(np.int64)
        rows = []
        kept = np.zeros(len(window), bool)
        kept[distinct_at] = True
        for bucket in np.unique(window_bucket):
            here = window_bucket == bucket
            known = window[here & kept]
            rows.append((int(bucket), known["one"].tobytes(), window[here & alone].tobytes()))
        found = pa.table(
            [pa.nulls(len(rows), pa.int64())] * 4
            + [
                pa.array([row[0] for row in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()),
                pa.array([row[1] for row in rows], pa.binary()), pa.array([row[2] for row in rows], pa.binary()),
            ],
            schema=_FOUND,
        )
        return pa.concat_tables([spans, found])

    return task


def _merged(least: int):
    """Of one range of window keys: windows alone in their shard that another shard has, found by binary search in
    the sorted keys of all."""

    def task(table: pa.Table) -> pa.Table:
        known = np.sort(np.frombuffer(b"".join(table.column("known").to_pylist()), np.uint64))
        unknown = np.frombuffer(b"".join(table.column("unknown").to_pylist()), _WINDOW)
        times = np.searchsorted(known, unknown["one"], "right") - np.searchsorted(known, unknown["one"], "left")
        found = unknown[times > 1]
        return pa.table(
            {
                "doc_id": pa.array(found["doc"].copy(), pa.int64(), mask=found["null"].astype(bool)),
                "key": pa.array(found["key"].copy(), pa.int64()),
                "start": pa.array(found["start"].copy(), pa.int64()),
                "behind": pa.array(found["start"] + least, pa.int64()),
            }
        )

    return task


def word_runs(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows of ``width`` words that own equal anchors: text, anchor, hash of its words, first and last
    window start among all words, and whether the text has no earlier run of these words. Long texts are cut into runs
    more often."""
    found = []
    for begin in range(0, len(hashes) - width + 1, WORD_SEGMENT):
        part = hashes[begin : begin + WORD_SEGMENT + width - 1]
        sums, count = prefix_sums(part), len(part) - WORD_GRAM + 1
        grams = spans_of(sums, np.arange(count), np.arange(WORD_GRAM, WORD_GRAM + count))
        owned = sliding_least(grams, width - WORD_GRAM + 1)
        text = np.searchsorted(first, np.arange(begin, begin + len(owned)), "right") - 1
        start = np.flatnonzero(np.arange(begin, begin + len(owned)) + width <= first[text + 1])
        if not len(start):
            continue
        value, of = owned[start], text[start]
        head = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])))
        last = start[np.append(head[1:], len(start)) - 1]
        whole = spans_of(sums, start[head], last + width)
        found.append((of[head], value[head], whole, start[head] + begin, last + begin))
    if not found:
        return (*(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.uint64, np.int64, np.int64)), np.zeros(0, bool))
    text, anchor, whole, start, last = (np.concatenate(column) for column in zip(*found))
    return text, anchor, whole, start, last, _new_in_text(text, whole)


def _new_in_text(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a text has a value for the first time."""
    order = np.lexsort((value, text))
    fresh = np.ones(len(order), bool)
    fresh[order[1:]] = (value[order[1:]] != value[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    return fresh


RUNS = "doc_id long, key long, anchor long, whole long, first long, last long, times int"


def _word_runs(width: int):
    """The anchors of the windows of words of each document. Starts are counted in words of the text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in batches_of(whole_batch, "text"):
                hashes, begins = plain_words(*text_bytes(batch.column("text")), NOT_SPACE)
                text, anchor, whole, first, last, fresh = word_runs(hashes, begins, width)
                owner = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(owner),
                        batch.column("key").take(owner),
                        pa.array(anchor.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(first - begins[text]),
                        pa.array(last - begins[text]),
                        pa.array(fresh.astype(np.int32)),
                    ],
                    ["doc_id", "key", "anchor", "whole", "first", "last", "times"],
                )

    return task


WINDOWS = "doc_id long, key long, window long, start long, times int, known boolean"


def _word_windows(width: int):
    """The windows of words in the given runs of each document. Those of runs known from several rows count twice."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                hashes, begins = plain_words(*text_bytes(batch.column("text")), NOT_SPACE)
                runs = batch.column("runs")
                of = runs.value_parent_indices().to_numpy()
                first, last, known = (
                    runs.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("first", "last", "known")
                )
                sizes = last - first + 1
                text = np.repeat(of, sizes)
                start = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
                place = start + begins[text]
                window = spans_of(prefix_sums(hashes), place, place + width)
                known = np.repeat(known.astype(bool), sizes)
                times = np.where(known, 2, _new_in_text(2 * text + known, window)).astype(np.int32)
                owner = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(owner),
                        batch.column("key").take(owner),
                        pa.array(window.view(np.int64)),
                        pa.array(start),
                        pa.array(times),
                        pa.array(known),
                    ],
                    ["doc_id", "key", "window", "start", "times", "known"],
                )

    return task


def _passages(rows: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """Spans of words (``doc_id``, ``key``, ``start``, ``behind``) in windows of ``width`` words that other rows have."""
    found = scratch.write(rows.mapInArrow(_word_runs(width), RUNS), "runs")
    # Where all runs of an anchor are equal, each of their windows is in every row that has the anchor.
    repeated = (
        found.groupBy("anchor")
        .agg(F.sum("times").alias("rows"), (F.min("whole") == F.max("whole")).alias("equal"))
        .filter("rows > 1")
        .drop("rows")
    )
    shared = scratch.write(found.join(repeated, "anchor").drop("anchor"), "shared")
    scratch.drop(found)
    # Of the others, a run that several rows have needs no look at its windows, but one of its copies shows them to the
    # runs that only one row has.
    mixed = shared.filter("not equal")
    wholes = mixed.groupBy("whole").agg(
        (F.sum("times") > 1).alias("known"), F.min(F.struct("doc_id", "key", "first", "last")).alias("copy")
    )
    judged = scratch.write(mixed.join(wholes.drop("copy"), "whole"), "runs")
    place = ["doc_id", "key", "first", "last", "known"]
    runs = (
        judged.filter("not known").select(place)
        .unionAll(wholes.filter("known").select("copy.*", "known"))
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("first", "last", "known")).alias("runs"))
        .withColumnsRenamed({"doc_id": "doc_of", "key": "key_of"})
    )
    windows = scratch.write(
        rows.join(runs, _same("doc_id", "doc_of") & _same("key", "key_of"))
        .select("doc_id", "key", "text", "runs")
        .mapInArrow(_word_windows(width), WINDOWS),
        "windows",
    )
    often = windows.groupBy("window").agg(F.sum("times").alias("rows")).filter("rows > 1").select("window")
    single = (
        windows.filter("not known")
        .join(often, "window")
        .select("doc_id", "key", "start", (F.col("start") + width).alias("behind"))
    )
    equal = (
        shared.filter("equal")
        .select("doc_id", "key", "first", "last")
        .unionAll(judged.filter("known").select("doc_id", "key", "first", "last"))
        .select("doc_id", "key", F.col("first").alias("start"), (F.col("last") + width).alias("behind"))
    )
    return equal.unionAll(single)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary"


def _united(texts: int, of: np.ndarray, start: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of texts in order, those that overlap or touch as one: start and end of each, and where each text's begin
    (one more than there are texts)."""
    order = np.lexsort((start, of))
    of, start, behind = of[order], start[order], behind[order]
    # A step between texts that no span reaches over.
    base = of * (int(behind.max(initial=0)) + 2)
    reach = np.maximum.accumulate(base + behind)
    opens = np.flatnonzero(np.append(True, (base + start)[1:] > reach[:-1])[: len(of)])
    closes = np.append(opens[1:], len(of))[: len(opens)] - 1
    return start[opens], (reach - base)[closes], np.searchsorted(of[opens], np.arange(texts + 1))


def _without(with_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                rows = []
                spans = batch.column("spans")
                of = spans.value_parent_indices().to_numpy()
                start, behind, in_words = (
                    spans.flatten().field(name).to_numpy(zero_copy_only=False) for name in ("start", "behind", "words")
                )
                in_words = in_words.astype(bool)
                starts, ends, places = _united(len(batch), of[~in_words], start[~in_words], behind[~in_words])
                first, last, of_text = _united(len(batch), of[in_words], start[in_words], behind[in_words])
                counted = np.diff(np.append(0, np.cumsum(last - first))[of_text]).tolist()
                edges = np.column_stack([starts, ends])
                for place, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    body = data[begin:end].tobytes()
                    cut = edges[places[place] : places[place + 1]].ravel().tolist()
                    bounds = [0, *cut, len(body)]
                    kept = b"".join(body[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                    rows.append(
                        (len(body), len(body) - len(kept), len(cut) // 2, hashlib.sha256(kept).hexdigest(),
                         counted[place], kept if with_text else None)
                    )
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                columns = [pa.array([row[n] for row in rows], kind) for n, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *columns],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"],
                )

    return task


def _same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def without_repeats(docs: DataFrame, options: SuffixOptions | None = None, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256``, ``n_passage_words`` and, with ``with_text``, ``kept``, the remaining bytes.

    A byte goes if a ``least``-byte string over it also starts anywhere else, in the same text or another; every copy
    goes, overlaps count, and all strings are judged on the input. Windows lie within one text.

    ``n_passage_words`` counts the words (between white space, as written) in runs of ``passage`` words that another row
    has too, whatever white space is between them. They are only counted: no byte goes for them.

    Cases: a null text is empty; a text shorter than ``least`` loses nothing; rows that repeat an id or a whole text
    are texts of their own, so equal long texts lose everything; cuts may fall inside a character; an empty table
    gives no rows; other columns are ignored.
    """
    options = options or SuffixOptions()
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    found = scratch.write(rows.mapInArrow(_anchored(options), ANCHORS), "anchors")
    repeated = scratch.write(found.groupBy("anchor").agg(F.sum("times").alias("total")).filter("total > 1"), "repeated")
    often = F.sum(F.when(F.col("total") > options.spread_from, F.col("total")))
    total, spread = (value or 0 for value in repeated.agg(F.sum("total"), often).first())
    # A run has half as many windows as the shortest repeat has bytes; they are merged by parts of their keys.
    bucket_bits = max(4, min(32, (spread * options.least // (2 * MERGED)).bit_length()))
    # A window run of an anchor is about one and a half times the shortest repeat long.
    shards = max(1, -(-total * options.least * 3 // (2 * options.shard_bytes)))
    of_doc = (
        found.join(repeated, "anchor")
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("anchor", "total")).alias("repeated"))
        .withColumnsRenamed({"doc_id": "doc_of", "key": "key_of"})
    )
    pieces = (
        rows.join(of_doc, _same("doc_id", "doc_of") & _same("key", "key_of"))
        .select("doc_id", "key", "text", "repeated")
        .mapInArrow(_cut_pieces(options), PIECES)
    )
    parts = F.ceil(F.col("total") / options.spread_from).cast("long")
    salt = F.pmod(F.xxhash64("doc_id", "key", "first"), parts)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("anchor", salt), F.lit(shards)))
    judged = scratch.write(pieces.groupBy("shard").applyInArrow(_shard(options, bucket_bits), FOUND), "judged")
    across = (
        judged.filter("bucket is not null")
        .groupBy("bucket")
        .applyInArrow(_merged(options.least), "doc_id long, key long, start long, behind long")
    )
    spans = (
        judged.filter("bucket is null")
        .select("doc_id", "key", "start", "behind")
        .unionAll(across)
        .withColumn("words", F.lit(False))
        .unionAll(_passages(rows, options.passage, scratch).withColumn("words", F.lit(True)))
        .groupBy("doc_id", "key")
        .agg(F.collect_set(F.struct("start", "behind", "words")).alias("spans"))
        .withColumnsRenamed({"doc_id": "doc_of", "key": "key_of"})
    )
    joined = rows.join(spans, _same("doc_id", "doc_of") & _same("key", "key_of"), "left").select(
        "doc_id", "text", "spans"
    )
    kept = joined.mapInArrow(_without(with_text), KEPT)
    scratch.drop(found, repeated)
    return kept if with_text else kept.drop("kept")
