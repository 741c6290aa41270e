"""Whitening of embeddings by a covariance in two passes.

Entries are scaled to whole numbers, so the first pass sums them exactly, in any order and by any number of tasks. The second
pass centres each batch by that mean and adds its outer products, a product of matrices; partial sums of a task are one row
and are merged by treeAggregate, so the driver gets a matrix of dimensions x dimensions, whatever the count of rows. Its eigenvectors
(LAPACK, symmetric) are broadcast, and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship

#: x = floor(SCALE * c) + SHIFT. Entries are held to +-LIMIT, beyond which a double isn't a whole number of SCALE-ths anyway.
SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**42
#: Vectors that are worked on at once.
ROWS = 4096
_HALF = 31


@dataclass
class Sums:
    """Count and exact sum of the vectors of each length."""

    by_length: dict[int, tuple[int, list[int]]] = field(default_factory=dict)

    def add(self, length: int, n: int, total: list[int]) -> Sums:
        m, before = self.by_length.get(length, (0, [0] * length))
        self.by_length[length] = m + n, [a + b for a, b in zip(before, total, strict=True)]
        return self

    def merge(self, other: Sums) -> Sums:
        for length, (n, total) in other.by_length.items():
            self.add(length, n, total)
        return self


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred sum of outer products of some vectors, which any two can merge."""

    n: int = 0
    mean: np.ndarray | float = 0.0
    outer: np.ndarray | float = 0.0

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        mean = rows.mean(0)
        centred = rows - mean
        return Moments(len(rows), mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.outer + other.outer + np.outer(gap, gap) * (self.n * other.n / n))


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S; unit components by falling variance (columns), their variances and shares of the whole."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    #: Largest absolute entry of (covariance of the whitened vectors) - identity; None if no component has a variance.
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # whole numbers of any size, rounded once

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors of whole ones; a component without variance gives NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, (x - self.mean) @ self.components / np.sqrt(self.variances), np.nan)

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum of (n * x - S)**2 of each vector, exactly."""
        most = max((abs(self.n * int(v) - s) for v, s in zip([*x.min(0), *x.max(0)], self.sums * 2, strict=True)), default=0) if len(x) else 0
        if len(self.sums) * most**2 < 1 << 63 and self.n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, self.sums), default=0) < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1)
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def whole_vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: places in the batch and whole numbers of the vectors of that length that can be used."""
    lists = batch.column(column)
    lists = lists.cast(pa.large_list(pa.float64()))
    flat = lists.flatten()
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    begin = np.cumsum(n) - n
    for length in np.unique(n[n > 0]):
        at = np.flatnonzero(n == length)
        for i in range(0, len(at), ROWS):
            some = at[i : i + ROWS]
            v = values[begin[some][:, None] + np.arange(length)]
            good = np.isfinite(v).all(1)
            if good.any():
                yield some[good], np.floor(np.clip(v[good], -LIMIT, LIMIT) * SCALE).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each length in a task: its count, and sums as two halves, neither of which can overflow."""
    mine = Sums()
    for batch in batches:
        for at, x in whole_vectors(batch, 0):
            high, low = (x >> _HALF).sum(0), (x & (1 << _HALF) - 1).sum(0)
            mine.add(x.shape[1], len(at), [(int(h) << _HALF) + int(w) for h, w in zip(high, low, strict=True)])
    names = ["length", "n", "total"]
    rows = [(k, n, [str(v) for v in total]) for k, (n, total) in mine.by_length.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))], names)


def _outer(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for a task: its sum of outer products of centred vectors."""
    total = np.zeros((len(mean), len(mean)))
    for batch in batches:
        for _, x in whole_vectors(batch, 0):
            if x.shape[1] == len(mean):
                centred = x - mean
                total += centred.T @ centred
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["outer"])


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    """A row for a task: count, mean and outer products of its whitened vectors."""
    mine = Moments()
    for batch in batches:
        for _, x in whole_vectors(batch, 0):
            if x.shape[1] == len(model.sums):
                mine = mine.merge(Moments.of(model.project(x)[:, model.variances > 0]))
    if mine.n:
        yield pa.RecordBatch.from_arrays([pa.array([mine.n], pa.int64()), pa.array([mine.mean.tobytes()], pa.binary()), pa.array([mine.outer.tobytes()], pa.binary())], ["n", "mean", "outer"])


def _square(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data).reshape(n, n)


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8, length: int | None = None) -> Whitening | None:
    """Mean, components and variances of all vectors that can be used; None without any.

    Null and empty vectors, and those that hold a null or an entry that isn't finite, can't; of the others, those of
    `length` count, by default the one that most of them have (of several, the largest)."""
    ship(vectors.sparkSession)
    given = vectors.select(F.col(column).cast("array<double>"))
    sums = given.mapInArrow(_sums, "length long, n long, total array<string>").rdd.treeAggregate(Sums(), lambda a, r: a.add(r.length, r.n, [int(v) for v in r.total]), Sums.merge)
    if length is None:
        length = max(sums.by_length, key=lambda k: (sums.by_length[k][0], k), default=0)
    n, total = sums.by_length.get(length, (0, []))
    if not n:
        return None
    mean = np.array([s / n for s in total])
    cov = given.mapInArrow(partial(_outer, mean=mean), "outer binary").rdd.map(lambda r: _square(r.outer, length)).treeAggregate(np.zeros((length, length)), np.add, np.add) / n
    values, found = np.linalg.eigh(cov)
    k = min(components, length)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    found = found * np.where(np.take_along_axis(found, np.abs(found).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    rounding = length * np.finfo(float).eps * max(trace, 0.0)
    model = Whitening(n, total, found, np.where(values > rounding, values, 0.0), values / trace if trace > 0 else np.zeros(k))
    some = int((model.variances > 0).sum())
    if not some:
        return model
    # measured, not derived: the whitened vectors of all rows are made and their covariance is taken
    rows = given.mapInArrow(partial(_whitened, model=model), "n long, mean binary, outer binary").rdd
    moments = rows.map(lambda r: Moments(r.n, np.frombuffer(r.mean), _square(r.outer, some))).treeAggregate(Moments(), Moments.merge, Moments.merge)
    return Whitening(n, total, found, model.variances, model.explained, float(np.abs(moments.outer / n - np.eye(some)).max()))


def _projected(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Whitening = shared.value
    for batch in batches:
        for at, x in whole_vectors(batch, 1):
            if x.shape[1] != len(model.sums):
                continue
            y = model.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.reshape(-1), from_pandas=True))
            away = model.deviations(x)
            away = pa.array(away, pa.int64()).cast(pa.decimal128(38, 0)) if isinstance(away, np.ndarray) else pa.array([a if a < 10**38 else None for a in away], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), away, lists], ["row", "deviation", "whitened"])


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 8, length: int | None = None) -> tuple[DataFrame, Whitening | None]:
    """row (a struct of all columns), deviation, whitened of every vector that fit counts, and the fitted model.

    deviation is the sum over dimensions of (n * x - S)**2, exact (null beyond 38 digits); whitened has a value for each
    component, null for one whose variance is no more than rounding error.

    Null, empty, ragged (of another length than most) and not finite vectors are left out; repeated rows count each; ids
    may be null; other columns of any name are carried in row. Entries beyond 2**42 count as that. Without vectors there
    are no rows. The driver holds length x length numbers, a task ROWS vectors.
    """
    model = fit(vectors, column, components, length)
    rows = vectors.select(F.struct("*").alias("row"), F.col(column).cast("array<double>").alias("v"))
    schema = StructType([rows.schema["row"], *StructType.fromDDL("deviation decimal(38,0), whitened array<double>").fields])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    return rows.mapInArrow(partial(_projected, shared=vectors.sparkSession.sparkContext.broadcast(model)), schema), model


def whitening_report(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component; see whiten.

    A deviation that a long can't hold fails the job rather than being rounded."""
    some = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).alias("v"))
    found, model = whiten(some, "v", components)
    shares = F.lit(np.array(model.explained if model else [], float))
    each = found.select(F.col("row.vec_id").alias("vec_id"), F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    error = model.identity_error if model else None
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
