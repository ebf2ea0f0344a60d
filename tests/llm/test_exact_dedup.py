"""Exact duplicates: the hash itself, plain grouping as reference, a history, copies in one hot bucket, edge cases."""

import hashlib
import re

import numpy as np
from folioscope.llm import exact_dedup


def plain(rows):
    """doc_id, keep_id, group_size and digest of every row; which of equal rows stays is left open."""
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key or 0))
    found = []
    for key, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[bare])
        digest = hashlib.sha256(bare.encode()).hexdigest()
        found.append((key, None if best[1] else best[2], len(groups[bare]), digest))
    return sorted(found, key=str)


def compared(got):
    return sorted(((row.doc_id, row.keep_id, row.group_size, row.text_sha256) for row in got), key=str)


def test_perfect_hash():
    random = np.random.default_rng(3)
    for n in (0, 1, 2, 500, 9_000):
        keys = random.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
        keys[: n // 2, 0] = 7  # digests that agree in their first word
        built = exact_dedup.PerfectHash.of(keys)
        again = exact_dedup.PerfectHash.unpacked(built.packed())
        assert sorted(again.slots(keys).tolist()) == list(range(n))
        assert len(built.packed()) <= 80 * 8 + 3 * n
        others = random.integers(0, 1 << 63, (100, 4), dtype=np.uint64)
        assert ((again.slots(others) >= -1) & (again.slots(others) < max(n, 1))).all()


def rows_of(n):
    random = np.random.default_rng(n)
    texts = [f"text {k}{' ' * int(random.integers(0, 3))} of the\tcorpus é" for k in random.integers(0, n // 2 + 1, n)]
    return [(int(key), text) for key, text in zip(random.permutation(n), texts)]


def test_groups_match_plain_ones(spark, monkeypatch):
    rows = rows_of(400) + [(1000 + n, "the very same text" + " " * (n == 77)) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for keys, unit in ((8_192, 16_384), (16, 10)):
        # Small buckets, and rows of the hot one spread over many tasks.
        monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", keys)
        monkeypatch.setattr(exact_dedup, "UNIT_ROWS", unit)
        got = exact_dedup.exact_groups(docs).collect()
        assert compared(got) == plain(rows)
        assert {row.doc_id for row in got if row.kept} == {row.keep_id for row in got}
        assert {row.keep_id for row in got if row.doc_id >= 1000} == {1077}


def test_history(spark):
    old = [(n, f"old {n % 5}") for n in range(20)]
    new = [(100, "old  3"), (101, "fresh"), (102, "fresh "), (103, "old 1, but not the same"), (104, None)]
    index = exact_dedup.history_index(spark.createDataFrame(old, "doc_id long, text string"))
    docs = spark.createDataFrame(new, "doc_id long, text string")
    got = {row.doc_id: (row.keep_id, row.group_size, row.kept) for row in exact_dedup.exact_groups(docs, index).collect()}
    # The history's document stays even where a new copy is longer.
    assert got == {100: (3, 5, False), 101: (102, 2, False), 102: (102, 2, True), 103: (103, 1, True), 104: (104, 1, True)}
    kept = exact_dedup.without_repeats(docs.selectExpr("*", "1 AS row", "'x' AS row_number", "2 AS digest"), index)
    assert kept.columns == ["doc_id", "text", "row", "row_number", "digest"]
    assert sorted(row.doc_id for row in kept.collect()) == [102, 103, 104]
    empty = exact_dedup.history_index(docs.limit(0))
    assert compared(exact_dedup.exact_groups(docs, empty).collect()) == plain(new)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, "a"), (None, "a"), (4, "a"), (5, "b"), (5, "b"), (5, "b"),
            (6, "x" * 300_000), (7, "x" * 300_000 + " "), (8, "A"), (9, "a ")]
    docs = spark.createDataFrame([(*row, "c", 1) for row in rows], "doc_id long, text string, digest string, row int")
    got = exact_dedup.exact_groups(docs).collect()
    assert compared(got) == plain(rows)
    # One row of each group stays, of equal rows too.
    assert sorted((row.doc_id for row in got if row.kept), key=str) == sorted([3, 4, 5, 7, 8, 9], key=str)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup.without_repeats(docs.limit(0)).columns == docs.columns
    assert exact_dedup.without_repeats(docs).count() == 6
