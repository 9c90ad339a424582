"""PCA whitening of embeddings, with eigenvectors to double precision.

Vectors become whole numbers, so that counts, sums and deviations are exact. Passes over the rows, each a scan without a shuffle
of vectors: counts per length, sums per dimension, the covariance (each task multiplies its centred rows and sends one matrix
row per dimension), the covariance of the result, and the result.

The eigenvectors come from a single-precision solver and are corrected by the iteration of Ogita and Aishima (Japan J. Indust.
Appl. Math. 35, 2018; 36, 2019), which consists of matrix products in higher precision and converges quadratically.
Eigenvalues that are too close for it form a cluster; the matrix, shifted by the cluster's mean, is solved inside the span of
the cluster's vectors, which are turned accordingly before the iteration goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from hirelake.llm.columns import free

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Entries whose whole number would not fit are moved to this bound.
LARGEST = 1 << 61
# Sums are kept in two halves of so many bits, so that they cannot overflow.
HALF = 31
# Rows multiplied at a time.
BLOCK = 4096
STEPS = 12
# Eigenvalues nearer than this share of the matrix's norm are told apart by rounding only.
NEAREST = 1e-13
# The precise type of the last steps; as wide as the machine has.
WIDE = np.longdouble


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole (no null or non-finite entry), and the lengths of all."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = lengths >= 0
    good[owner[~np.isfinite(values)]] = False
    return good, lengths


def _whole(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with ``size`` whole entries, and those as a matrix of whole numbers."""
    good, lengths = _vectors(column)
    good &= lengths == size
    values = pc.list_flatten(column.filter(pa.array(good))).cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(SCALE * values), -LARGEST, LARGEST)
    return np.flatnonzero(good), scaled.astype(np.int64).reshape(-1, size) + SHIFT


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, lengths = _vectors(batch.column(0))
        sizes, counts = np.unique(lengths[good], return_counts=True)
        yield pa.RecordBatch.from_pydict({"size": sizes, "n": counts.astype(np.int64)})


def _sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _whole(batch.column(0), size)[1]
            halves = [(rows >> HALF).sum(axis=0), (rows & ((1 << HALF) - 1)).sum(axis=0)]
            yield pa.RecordBatch.from_pydict({"at": np.arange(size), "high": halves[0], "low": halves[1]})

    return run


def _rows_of_sum(total: np.ndarray) -> pa.RecordBatch:
    """A matrix as rows ``task, at, line``."""
    size = len(total)
    lines = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * size), pa.array(total.ravel()))
    return pa.RecordBatch.from_pydict({"task": np.full(size, TaskContext.get().partitionId()), "at": np.arange(size),
                                       "line": lines})


def _gram(size: int, transform, width: int):
    """The sum of the products of the transformed rows, one matrix per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _whole(batch.column(0), size)[1]
            for at in range(0, len(rows), BLOCK):
                part = transform(rows[at:at + BLOCK])
                total += part.T @ part
        yield _rows_of_sum(total)

    return run


def _added(size: int):
    """Adds the lines of one matrix row, in the order of the tasks, so that a repeated run gives the same bits."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        lines = pc.list_flatten(table["line"].combine_chunks()).to_numpy().reshape(-1, size)
        total = lines.sum(axis=0)
        return pa.table({"at": table["at"].slice(0, 1), "line": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return run


def _matrix(vectors: DataFrame, size: int, transform, width: int) -> np.ndarray:
    """Sum of products over all rows. The driver gets one matrix; the tasks' matrices are added row by row in Spark."""
    parts = vectors.mapInArrow(_gram(size, transform, width), "task long, at long, line array<double>")
    lines = parts.groupBy("at").applyInArrow(_added(width), "at long, line array<double>").orderBy("at").collect()
    return np.array([r["line"] for r in lines]).reshape(width, width)


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: the eigenvalues that belong to ``x``, the correction of ``x``, and below which gap it is not to be trusted."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = _symmetric(x.T @ (a @ x))  # else rounding, divided by small gaps, would tilt the vectors against each other
    values = np.diagonal(s) / (1 - np.diagonal(r))
    off = s - np.diag(values)
    norm = float(np.linalg.norm(a.astype(float)))
    least = max(NEAREST * norm, 2 * (np.linalg.norm(off.astype(float)) + norm * np.linalg.norm(r.astype(float))))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > least
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return values, e, least


def _clusters(values: np.ndarray, least: float) -> list[np.ndarray]:
    """Places of falling eigenvalues whose neighbours are no further than ``least``; only groups of two or more."""
    order = np.argsort(-values.astype(float), kind="stable")
    fall = values[order]
    cuts = np.flatnonzero(np.abs(np.diff(fall)) > least) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _turned(a: np.ndarray, x: np.ndarray, group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The vectors of a cluster, turned to the eigenvectors of the shifted matrix inside their span."""
    own = x[:, group]
    small = _symmetric(own.T @ (a @ own - own * values[group].mean()))
    scale = float(np.abs(small).max())
    if not scale > 0:
        return own
    return own @ np.linalg.eigh((small / scale).astype(float))[1].astype(x.dtype)


def eigenvectors(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns; the largest entry of each is positive) of a symmetric matrix.

    Single precision first, then corrections in double precision and in the widest type, each until they no longer shrink.
    Vectors of equal eigenvalues are some basis of their span.
    """
    scale = float(np.abs(a).max(initial=0))
    if not scale > 0:
        return np.zeros(len(a)), np.eye(len(a))
    scaled = _symmetric(np.asarray(a, dtype=float) / scale)
    x = np.linalg.eigh(scaled.astype(np.float32))[1]
    for kind in (float, WIDE):
        wide, x, before = scaled.astype(kind), x.astype(kind), np.inf
        for _ in range(steps):
            values, e, least = _correction(wide, x)
            x = x + x @ e
            size = float(np.abs(e).max())
            if size < 1e-17 or size < 1e-6 and size >= before / 2:
                break
            before = size
            for group in _clusters(values, least):
                x[:, group] = _turned(wide, x, group, values)
    values = np.einsum("ij,ij->j", x, wide @ x) / np.einsum("ij,ij->j", x, x)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    values, x = (values[order] * scale).astype(float), x[:, order].astype(float)
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values, x * sign


@dataclass
class Whitener:
    """What the rows are whitened with; its size depends on the dimension only."""

    n: int
    totals: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.totals)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """``x - S / n`` of whole numbers: the nearest whole number first, so that large numbers lose nothing."""
        base = np.array([s // self.n for s in self.totals], dtype=np.int64)
        rest = np.array([s % self.n / self.n for s in self.totals])
        return (rows - base) - rest

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ self.vectors / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> np.ma.MaskedArray:
        """Sum of ``(n x - S)`` squared per row; masked where it does not fit into 64 bits."""
        base = np.array([s // self.n for s in self.totals], dtype=np.int64)
        rest = np.array([s % self.n for s in self.totals], dtype=np.int64)
        rough = ((self.centred(rows) * self.n) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            off = (rows - base) * self.n - rest
            return np.ma.masked_array((off * off).sum(axis=1), mask=rough > 9.22e18)


def fit(docs: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all usable rows; None if there are none.

    The dimension is the most frequent length (the larger one of a tie); rows of other lengths are not used. Components whose
    variance is zero to double precision are left out.
    """
    vectors = docs.select(F.col(vector_col).alias("v"))
    lengths = vectors.mapInArrow(_lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    best = lengths.filter("size > 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    size, n = best["size"], best["n"]
    sums = vectors.mapInArrow(_sums(size), "at long, high long, low long").groupBy("at").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).orderBy("at").collect()
    totals = [(int(r["high"]) << HALF) + int(r["low"]) for r in sums]
    model = Whitener(n, totals, np.ones(size), np.eye(size), 0.0)
    covariance = _matrix(vectors, size, model.centred, size) / n
    values, x = eigenvectors(covariance)
    kept = np.flatnonzero(values[:components] > size * np.finfo(float).eps * max(values[0], 0.0))
    model.trace = float(np.trace(covariance))
    model.values, model.vectors = values[kept], x[:, kept]
    if len(kept):
        again = _matrix(vectors, size, model.whitened, len(kept)) / n
        model.identity_error = float(np.abs(again - np.eye(len(kept))).max())
    return model


def whiten(docs: DataFrame, model: Whitener | None, keep: list[str], vector_col: str = "embedding",
           names: tuple[str, str, str, str] = ("component", "deviation", "whitened", "explained")) -> DataFrame:
    """The columns ``keep``, then ``component`` (from 1), ``deviation, whitened, explained``: a row per used row and component.

    Rows whose vector is null, has a null, NaN or infinite entry or another length than the model are left out; repeated rows are
    rows of their own. ``deviation`` is null where it exceeds 64 bits. Without a model (an empty table, or no usable vector), or
    if no dimension varies, there are no rows. Other columns are not read and may have any names.
    """
    kinds = zip(names, (IntegerType(), LongType(), DoubleType(), DoubleType()), strict=True)
    result = StructType([docs.schema[c] for c in keep] + [StructField(n, k) for n, k in kinds])
    if model is None or not len(model.values):
        return docs.sparkSession.createDataFrame([], result)
    (vector,) = free(keep, "vector")
    width = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.values / model.trace
        for batch in batches:
            rows, whole = _whole(batch.column(batch.num_columns - 1), model.size)
            for at in range(0, len(rows), BLOCK):
                part, own = whole[at:at + BLOCK], rows[at:at + BLOCK]
                deviation = model.deviations(part)
                columns = [c.take(pa.array(np.repeat(own, width))) for c in batch.columns[:-1]]
                columns += [pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(own))),
                            pa.array(np.repeat(deviation.data, width), mask=np.repeat(np.ma.getmaskarray(deviation), width)),
                            pa.array(model.whitened(part).ravel()), pa.array(np.tile(explained, len(own)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return docs.select(*keep, F.col(vector_col).alias(vector)).mapInArrow(run, result)
