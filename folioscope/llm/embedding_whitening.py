"""Whitening of embeddings: spectral divide and conquer on the covariance, then a broadcast projection.

The covariance is summed by tasks; the driver gets one d x d matrix. There, the polar factor of the shifted matrix (QDWH:
dynamically weighted Halley iterations) gives the projector on the eigenvalues above the shift. Its range and its kernel
are invariant, so the matrix splits into two smaller ones, down to single components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch

EPS = np.finfo(float).eps
# Entries of a vector are counted in 1 / SCALE from -OFFSET on.
SCALE, OFFSET = 64, 1_000_000
# Beyond this an entry counts as this, so that sums of whole numbers do not wrap.
LARGEST = float(1 << 53)
# A direction with less than this part of the greatest variance has none that doubles can tell from rounding.
LEAST_VARIANCE = 1e-10
# Rows of a batch that are multiplied at a time.
ROWS = 4_096


@dataclass(frozen=True)
class Components:
    """Eigenvalues, falling, and unit eigenvectors (columns)."""

    values: np.ndarray
    vectors: np.ndarray


def polar(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without a zero eigenvalue: its sign, eigenvalue by eigenvalue."""
    size = len(matrix)
    x = matrix / max(np.abs(matrix).sum(axis=0).max(), np.finfo(float).tiny)
    # A lower bound of the smallest singular value; a smaller one costs an iteration, a greater one would cost accuracy.
    low = max(np.abs(np.diag(np.linalg.qr(x)[1])).min() / size, EPS)
    for _ in range(60):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        a = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(size)]))
            step = b / c * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        else:
            step = b / c * x + (a - b / c) * np.linalg.solve(np.eye(size) + c * (x.T @ x), x.T).T
        step = (step + step.T) / 2
        change = np.linalg.norm(step - x)
        x, low = step, min(1.0, low * (a + b * square) / (1 + c * square))
        if change <= np.cbrt(EPS) and 1 - low <= 10 * EPS:
            return x
    return x


def _split(matrix: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, the one with the greater eigenvalues first. None where all
    eigenvalues are equal within rounding of a matrix of size ``scale``."""
    size = len(matrix)
    middle = np.trace(matrix) / size
    width = np.linalg.norm(matrix - middle * np.eye(size))
    if width <= 4 * size * EPS * scale:
        return None
    random = np.random.default_rng(size)
    diagonal = np.median(np.diag(matrix))
    shifts = [middle, diagonal, *(middle + width / np.sqrt(size) * random.uniform(-1, 1, 40))]
    best = None
    for shift in shifts:
        sign = polar(matrix - shift * np.eye(size))
        above = (np.eye(size) + sign) / 2
        rank = int(round(np.trace(above)))
        # An eigenvalue at the shift has no sign; then the factor is no reflection.
        if not 0 < rank < size or np.linalg.norm(sign @ sign - np.eye(size)) > 1e-10 * size:
            continue
        start = random.standard_normal((size, size))
        upper = np.linalg.qr(above @ np.linalg.qr(above @ start[:, :rank])[0])[0]
        lower = start[:, rank:] - above @ start[:, rank:]
        basis = np.linalg.qr(np.hstack([upper, lower]))[0]
        error = np.linalg.norm(basis[:, rank:].T @ matrix @ basis[:, :rank])
        if best is None or error < best[0]:
            best = (error, basis[:, :rank], basis[:, rank:])
        if error <= 10 * size * EPS * scale:
            break
    if best is None:
        raise ArithmeticError("no shift separates the eigenvalues")
    return best[1], best[2]


def eigen(matrix: np.ndarray) -> Components:
    """Eigenvalues and eigenvectors of a symmetric matrix by divide and conquer. The largest entry of each vector is
    positive."""
    matrix = (matrix + matrix.T) / 2
    scale = np.linalg.norm(matrix)
    vectors = np.zeros((len(matrix), 0))
    open_parts = [(matrix, np.eye(len(matrix)))]
    while open_parts:
        part, basis = open_parts.pop()
        halves = _split(part, scale) if len(part) > 1 else None
        if halves is None:
            vectors = np.hstack([vectors, basis])
            continue
        for half in halves:
            inner = half.T @ part @ half
            open_parts.append(((inner + inner.T) / 2, basis @ half))
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    if len(matrix):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(matrix))] < 0, -1.0, 1.0)
    return Components(values, vectors)


def whole_vector(vector: Column) -> Column:
    """The entries as whole numbers, null for a vector that is null or has a null or non-finite entry."""
    finite = F.forall(vector, lambda entry: F.coalesce(F.abs(entry.cast("double")) < float("inf"), F.lit(False)))
    counted = F.transform(
        vector,
        lambda entry: F.floor(F.greatest(F.least(entry.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + OFFSET,
    )
    return F.when(finite, counted)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch by dimension: row numbers and a matrix of whole numbers, ``ROWS`` rows at a time."""
    column = batch.column("x")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        for first in range(0, len(rows), ROWS):
            part = rows[first : first + ROWS]
            yield part, flat[starts[part][:, None] + np.arange(size)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of each dimension, a row for each place; place -1 counts the vectors."""
    totals: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrices(batch):
            total = totals.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
            total[0] += len(x)
            # Columns of 4,096 rows of at most 2^53 + 10^6 each do not fit 64 bits; their halves do.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            for place, (upper, lower) in enumerate(zip(high.tolist(), low.tolist()), start=1):
                total[place] += (upper << 32) + lower
    for size, total in totals.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([size] * len(total), pa.int32()),
                pa.array(range(-1, len(total) - 1), pa.int32()),
                pa.array([str(value) for value in total], pa.string()),
            ],
            names=["size", "place", "total"],
        )


def _products(shared):
    """Products of centred vectors, projected where the model says so, and of a one beside them, summed in the task."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                centre, axes = shared.value[x.shape[1]]
                z = (x - centre) @ axes if axes is not None else x - centre
                z = np.hstack([z, np.ones((len(z), 1))])
                found[x.shape[1]] = found.get(x.shape[1], 0.0) + z.T @ z
        task = TaskContext.get().partitionId()
        for size, product in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size] * len(product), pa.int32()),
                    pa.array(range(len(product)), pa.int32()),
                    pa.array([task] * len(product), pa.int32()),
                    pa.array(list(product), pa.list_(pa.float64())),
                ],
                names=["size", "place", "task", "line"],
            )

    return multiply


def _add_lines(group: pa.Table) -> pa.Table:
    """The sum of one line of the product over all tasks, in the order of the tasks."""
    group = group.sort_by("task").combine_chunks()
    lines = np.asarray(group.column("line").combine_chunks().flatten()).reshape(len(group), -1)
    return pa.table(
        {
            "size": group.column("size").slice(0, 1),
            "place": group.column("place").slice(0, 1),
            "line": pa.array([lines.sum(axis=0)], pa.list_(pa.float64())),
        }
    )


def covariances(vectors: DataFrame, views: dict[int, tuple[np.ndarray, np.ndarray | None]]) -> dict[int, np.ndarray]:
    """The covariance (divisor n) of the vectors of each dimension, centred by ``views`` before they are multiplied and,
    where it holds axes, of their projections. The driver gets one matrix for each dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(views)
    partial = vectors.mapInArrow(_products(shared), "size int, place int, task int, line array<double>")
    added = partial.groupBy("size", "place").applyInArrow(_add_lines, "size int, place int, line array<double>")
    lines = sorted(added.collect(), key=lambda row: (row.size, row.place))
    found = {}
    for size in {row.size for row in lines}:
        product = np.array([row.line for row in lines if row.size == size])
        mean = product[-1, :-1] / product[-1, -1]
        found[size] = product[:-1, :-1] / product[-1, -1] - np.outer(mean, mean)
    return found


@dataclass(frozen=True)
class Whitening:
    """The fit for one dimension: number of distinct vectors, their sums, the axes (eigenvectors over square roots of
    eigenvalues), each component's share of the variance, and how far whitened covariance is from the identity."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([total / self.n for total in self.sums])


def fit(vectors: DataFrame, components: int = 16) -> dict[int, Whitening]:
    """Fit on a written table of distinct whole-number vectors ``x``, each dimension apart."""
    counted = vectors.mapInArrow(_sums, "size int, place int, total string")
    exact = counted.groupBy("size", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {(row.size, row.place): int(row.total) for row in exact}
    sizes = sorted({size for size, _ in totals if size})
    sums = {size: [totals[size, place] for place in range(size)] for size in sizes}
    centres = {size: np.array([total / totals[size, -1] for total in sums[size]]) for size in sizes}
    if not sizes:
        return {}
    views = {size: (centres[size], None) for size in sizes}
    measured = covariances(vectors.filter("size(x) > 0"), views)
    models, axes = {}, {}
    for size in sizes:
        found = eigen(measured[size])
        most = found.values[0] if found.values[0] > 0 else 1.0
        kept = min(components, int((found.values > LEAST_VARIANCE * most).sum()))
        axes[size] = found.vectors[:, :kept] / np.sqrt(found.values[:kept])
        models[size] = found.values[:kept] / max(np.trace(measured[size]), np.finfo(float).tiny)
    whitened = covariances(vectors.filter("size(x) > 0"), {size: (centres[size], axes[size]) for size in sizes})
    return {
        size: Whitening(
            totals[size, -1],
            sums[size],
            axes[size],
            models[size],
            float(np.abs(whitened[size] - np.eye(axes[size].shape[1])).max(initial=0.0)),
        )
        for size in sizes
    }


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the places of (n * x - sum)^2, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(abs(total) for total in sums)
    if most < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 < 1 << 63:
            return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38))
    apart = x.astype(object) * n - np.array(sums, object)
    squares = [int(total) for total in (apart * apart).sum(axis=1)]
    return pa.array([str(total) if total < 10**38 else None for total in squares], pa.string()).cast(pa.decimal128(38))


def _whitener(shared):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch):
                model = shared.value.get(x.shape[1])
                if model is None:
                    continue
                values = (x - model.centre) @ model.axes
                edges = np.arange(len(x) + 1, dtype=np.int32) * values.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array([x.shape[1]] * len(x), pa.int32()),
                        _deviations(x, model.n, model.sums),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(values.ravel())),
                    ],
                    names=["vec_id", "size", "deviation", "values"],
                )

    return whiten


def whitened(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Per vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``.

    A vector's entries c become whole numbers x = floor(64 c) + 1,000,000. The fit is over the distinct ones, ``n`` of
    them. ``deviation`` is the sum of (n x - sum)^2 (decimal, null beyond 38 digits); ``whitened`` is the projection of x
    minus the mean on the component, over the square root of its eigenvalue; ``explained`` its share of the variance.

    Cases: vectors that are null, or hold null or non-finite entries, give no rows; equal vectors count once in the fit and
    give rows each; a null id stays null; vectors of another dimension are fitted apart; a direction with under 1e-10 of the
    greatest variance is no component, so a single distinct vector, and a vector without entries, gives no rows; components
    of equal variance are any basis of theirs; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", whole_vector(F.col("embedding")).alias("x")).filter("x is not null")
    distinct = Scratch(spark, "whitening").write(rows.select("x").distinct(), "distinct")
    models = fit(distinct, components)
    shared = spark.sparkContext.broadcast(models)
    name = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {name}, size int, deviation decimal(38,0), values array<double>"
    found = rows.mapInArrow(_whitener(shared), schema)
    facts = spark.createDataFrame(
        [(size, model.n, model.explained.tolist(), model.identity_error) for size, model in models.items()],
        "size int, n long, shares array<double>, identity_error double",
    )
    found = found.join(F.broadcast(facts), "size")
    exploded = found.select("*", F.posexplode("values").alias("place", "whitened"))
    return exploded.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("shares", F.col("place")).alias("explained"),
        "identity_error",
    )
