"""Words of whole Arrow batches as positions and 64-bit hashes, without a Python loop over words.

Texts stay the UTF-8 bytes Arrow delivers. Word classes are sets of bytes: every class used here is made of ASCII
characters only, so a byte test and a character test agree. Work goes through the buffer in segments of about a
megabyte, cut between words, so a long text needs no more scratch memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_RANDOM = np.random.default_rng(20240607)
# Fixed random numbers: equal in every process, as hashes of different tasks are compared.
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(_RANDOM.integers(1, 1 << 62, dtype=np.uint64) * np.uint64(4) + np.uint64(3))
BACK = pow(int(STEP), -1, 1 << 64)
FACTORS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    member = np.zeros(256, dtype=bool)
    for first, last in ranges:
        member[first : last + 1] = True
    return member


NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS_DIGITS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def mix(values: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3: every bit of the result depends on every bit of the value."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def _segments(data: np.ndarray, member: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Cut the buffer between words, or after ``size`` bytes where the text has no place between words for long."""
    first = 0
    while first < len(data):
        last = min(first + size, len(data))
        while last < len(data):
            gaps = np.flatnonzero(~member[data[last : last + size]])
            last = last + int(gaps[0]) if len(gaps) else min(last + size, len(data))
            if len(gaps):
                break
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, start and end of every word, and the place of each text's first word (one more than there are texts).

    A word is a maximal run of bytes of the class within one text; its hash ignores the case of A-Z.
    """
    hashes, starts, ends = [], [], []
    for first, last in _segments(data, member):
        part = data[first:last]
        inside = member[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, last)] - first
        begins[cuts[inside[cuts]]] = True
        begin = np.flatnonzero(begins)
        if not len(begin):
            continue
        places = np.flatnonzero(inside)
        number = np.cumsum(begins, dtype=np.int32)[places] - 1
        inner = places - begin[number]
        powers = np.cumprod(np.full(int(inner.max()) + 1, STEP, np.uint64), dtype=np.uint64)
        values = BYTE_VALUES[LOWER[part[places]]] * powers[inner]
        first_of = np.searchsorted(places, begin)
        hashes.append(mix(np.add.reduceat(values, first_of)))
        count = np.diff(np.append(first_of, len(places)))
        starts.append(begin + first)
        ends.append(begin + first + count)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets)


def plain_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word as it is written, and the place of each text's first word (one more than there are texts).

    Sums of bytes times powers up to each byte are kept, so a word's hash is a difference of two of them.
    """
    hashes, starts = [], []
    for first, last in _segments(data, member):
        part = data[first:last]
        inside = member[part]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, last)] - first
        begins[cuts] = inside[cuts]
        cuts = cuts[cuts > 0] - 1
        closes[cuts] = inside[cuts]
        begin = np.flatnonzero(begins)
        hashes.append(spans_of(prefix_sums(BYTE_VALUES[part]), begin, np.flatnonzero(closes) + 1))
        starts.append(begin + first)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


@lru_cache(maxsize=4)
def _power_table(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, np.uint64)), dtype=np.uint64)


def _powers(base: int, count: int) -> np.ndarray:
    return _power_table(base, max(SEGMENT * 2, 1 << (count - 1).bit_length()))[:count]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, each times a power of its place."""
    return np.append(np.uint64(0), np.cumsum(values * _powers(int(STEP), len(values)), dtype=np.uint64))


def spans_of(sums: np.ndarray, begin: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Hash of the values from ``begin`` up to ``behind``, the same wherever they stand."""
    back = _powers(BACK, len(sums))
    return mix((sums[behind] - sums[begin]) * back[begin])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, by the place of its first word (also across texts)."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(width), np.uint64)
    for place in range(width):
        total += mix(hashes[place : place + count] * FACTORS[place])
    return mix(total)


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, put together, and where each text's begin (one more than texts).

    A shingle is a run of ``width`` words, or all words where there are fewer; a text without words has none.
    """
    data, offsets = text_bytes(column)
    hashes, _, _, first = words(data, offsets, NOT_SPACE)
    whole = windows(hashes, width)
    count = np.diff(first)
    sizes = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    found = np.empty(int(edges[-1]), np.uint64)
    for begin, words_in, place, size in zip(first[:-1].tolist(), count.tolist(), edges[:-1].tolist(), sizes.tolist()):
        if words_in >= width:
            part = found[place : place + size]
            part[:] = whole[begin : begin + size]
            part.sort()
        elif words_in:
            found[place] = windows(hashes[begin : begin + words_in], words_in)[0]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[edges[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return found[new], kept[edges]
