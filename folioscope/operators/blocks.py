"""Queries in blocks of bounded size, and the best rows per query inside a task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialize

SLACK = 1e-6
# Best rows one task keeps over all queries of a pass.
KEPT_ROWS = 1 << 20
# Candidates collected before they are cut to the best for the first time.
LEAST_CANDIDATES = 100_000
KEYS = ("chunk_id", "document_id", "chunk_index")


def in_blocks(
    queries: DataFrame, weight: Column, limit: int, k: int, search: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run ``search`` on the queries, in as many passes as it takes to keep a pass within ``limit`` and a task within
    ``KEPT_ROWS`` rows. Usually everything fits into one pass.

    ``weight`` is what one query adds to the data every task gets. Passes are run one after the other and their
    results written, so the driver holds the queries of one pass. Two queries with one id are an error.
    """
    row = queries.agg(
        F.sum(weight.cast("long")).alias("weight"),
        F.count("*").alias("queries"),
        F.count_distinct(F.struct("query_id")).alias("ids"),
    ).first()
    if row["ids"] < row["queries"]:
        raise ValueError("two queries have the same query_id")
    passes = max(1, math.ceil((row["weight"] or 0) / limit), math.ceil(row["queries"] * k / KEPT_ROWS))
    if passes == 1:
        return search(queries)
    block = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    results = (materialize(search(queries.filter(block == number)), "pass") for number in range(passes))
    return reduce(DataFrame.unionByName, results)


def keep_best(candidates: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows per query by class, score and position in the corpus."""
    keys = [
        ("query", "ascending"),
        ("complete", "descending"),
        ("ranking", "descending"),
        ("document_id", "ascending"),
        ("chunk_index", "ascending"),
    ]
    order = pc.sort_indices(candidates, sort_keys=keys).to_numpy()
    query = candidates["query"].to_numpy()[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.array([], dtype=int)
    sizes = np.diff(np.r_[starts, len(query)])
    rank = np.arange(len(query)) - np.repeat(starts, sizes)
    return candidates.take(pa.array(order[rank < k]))


def leaders(values: np.ndarray, k: int) -> np.ndarray:
    """Which cells of a row-by-query matrix may belong to the ``k`` largest of their query. Ties are all kept.

    The slack keeps cells that only differ by rounding; minus infinity marks cells without a value.
    """
    if len(values) <= k:
        return values > -np.inf
    floor = np.partition(values, len(values) - k, axis=0)[len(values) - k]
    return (values > -np.inf) & (values >= floor - SLACK)


class BestRows:
    """The best ``k`` rows per query seen so far in one task.

    Candidates are collected and cut to the best once they are as many as what was kept, so a row is sorted a bounded
    number of times on average, however many slices there are.
    """

    def __init__(self, queries: int, k: int, keys: Sequence[str] = KEYS):
        self.k = k
        self.names = list(keys)
        self.kept: pa.Table | None = None
        self.waiting: list[pa.Table] = []
        self.n_waiting = 0
        self.floor = np.full((queries, 2), -np.inf)

    def add(self, rows: pa.RecordBatch, query, row, complete, ranking, score) -> None:
        """Offer candidates. Those below the last known k-th row of their query are dropped at once."""
        at_class, at_ranking = self.floor[query, 0], self.floor[query, 1]
        open_rows = (complete > at_class) | ((complete == at_class) & (ranking >= at_ranking))
        query, row = query[open_rows], row[open_rows]
        if not len(query):
            return
        keys = rows.select(self.names).take(pa.array(row))
        columns = [
            pa.array(query.astype(np.int32)),
            pa.array(complete[open_rows].astype(np.int8)),
            pa.array(ranking[open_rows]),
            pa.array(score[open_rows]),
            *keys.columns,
        ]
        self.waiting.append(pa.table(columns, names=["query", "complete", "ranking", "score", *self.names]))
        self.n_waiting += len(query)
        if self.n_waiting >= max(LEAST_CANDIDATES, self.kept.num_rows if self.kept is not None else 0):
            self._cut()

    def _cut(self) -> None:
        if not self.waiting:
            return
        tables = self.waiting if self.kept is None else [self.kept, *self.waiting]
        self.kept = keep_best(pa.concat_tables(tables), self.k)
        self.waiting, self.n_waiting = [], 0
        query = self.kept["query"].to_numpy()
        last = np.flatnonzero(np.r_[query[1:] != query[:-1], True])
        counts = np.bincount(query, minlength=len(self.floor))
        full = last[counts[query[last]] == self.k]
        self.floor[query[full], 0] = self.kept["complete"].to_numpy()[full]
        self.floor[query[full], 1] = self.kept["ranking"].to_numpy()[full]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self._cut()
        if self.kept is not None:
            yield from self.kept.combine_chunks().to_batches()


BEST_SCHEMA = (
    "query int, complete byte, ranking double, score double, "
    "chunk_id string, document_id long, chunk_index long"
)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def shares(cost: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows, a row at least, of which those after the first cost less than ``limit`` together."""
    turn = np.cumsum(cost) // limit
    edges = np.flatnonzero(np.diff(turn, prepend=-1, append=np.inf))
    yield from zip(edges[:-1].tolist(), edges[1:].tolist())
