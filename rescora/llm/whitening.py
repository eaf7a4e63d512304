"""Whitening of embeddings by cyclic Jacobi rotations.

Vectors are put on a grid of 1/256: each entry c becomes the integer x = floor(256 * c). The model is fitted on each
distinct x vector once: tasks give exact sums by dimension, then the scatter of their vectors, centred on the mean
before they are multiplied; Spark adds the parts by cell of the matrix, and dimension x dimension doubles reach the
driver, whatever the number of rows. There, sweeps of rotations clear each pair of dimensions in turn, until what is off
the diagonal is nothing beside the diagonal entries of its row and column; so small eigenvalues are accurate too.
Components are sorted by eigenvalue, and the whitening matrix (components x dimension) is broadcast to score all rows.

Nulls and ties: rows whose vector is null or has null or non-finite entries are dropped, and so are those with entries
of 2**52 / 256 or beyond, which the grid can't tell apart. Vectors have the length that most distinct ones have (of
equally many, the longer); others are dropped, and empty vectors have no components. Repeated rows are given each, and fitted once. A
null vec_id is kept. Equal eigenvalues keep the order of their columns. A component without variance (under EMPTY of the
largest) has no whitened value. deviation is null where a long can't hold it. An empty table gives no rows. Extra
columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, materialise

GRID = 256
COMPONENTS = 4
#: Entries beyond this have no neighbours on the grid in double precision.
MOST = float(1 << 52)
#: Rotations stop where each off-diagonal entry is under this part of the root of its two diagonal entries.
SMALL, MOST_SWEEPS = 1e-15, 60
#: Eigenvalues under this part of the largest are rounding.
EMPTY = 1e-13
#: Vectors that are multiplied at once.
BLOCK = 1024
PARTIAL = "i int, v array<double>"


def on_grid(rows: DataFrame, vector: str) -> DataFrame:
    """`rows` with x, the vector as integers, in place of the vector; rows without a whole finite vector are dropped."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * GRID < MOST))
    rows = rows.where(F.col(vector).isNotNull() & whole)
    return rows.withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long"))).drop(vector)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scatter(mean: np.ndarray, project: np.ndarray | None = None):
    """A task's sum of products of its centred (and projected) vectors, a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mean) if project is None else len(project)
        total, any_ = np.zeros((d, d)), False
        for b in batches:
            x = _matrix(b.column("x"))
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK] - mean
                part = part if project is None else part @ project.T
                total += part.T @ part
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _covariance(fit: DataFrame, n: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    d = len(mean) if project is None else len(project)
    parts = fit.mapInArrow(_scatter(mean, project), PARTIAL).select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((d, d))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return (out + out.T) / (2 * n)


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, of a symmetric matrix by cyclic sweeps of rotations."""
    a, d = np.array(a, np.float64), len(a)
    v = np.eye(d)
    for _ in range(MOST_SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= SMALL * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])) or off == 0.0:
                    continue
                turned = True
                # the smaller angle that makes the entry zero
                ratio = (a[q, q] - a[p, p]) / (2.0 * off)
                t = (1.0 if ratio >= 0 else -1.0) / (abs(ratio) + np.hypot(ratio, 1.0))
                cos = 1.0 / np.hypot(t, 1.0)
                sin = t * cos
                turn = np.array([[cos, -sin], [sin, cos]])
                own = [p, q]
                top, bottom = a[p, p] - t * off, a[q, q] + t * off
                a[own] = turn @ a[own]
                a[:, own] = a[own].T
                a[p, p], a[q, q], a[p, q], a[q, p] = top, bottom, 0.0, 0.0
                v[own] = turn @ v[own]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[order]


@dataclass(frozen=True)
class Model:
    """n fitted vectors, their exact sums by dimension, and components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def kept(self) -> int:
        """Components with variance."""
        return int((self.values > EMPTY * max(self.values.max(initial=0.0), 0.0)).sum())

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors[: self.kept] / np.sqrt(self.values[: self.kept, None])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)**2, exact."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(1).tolist()
        exact = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x)
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of a table's vectors; None if no row has one."""
    bounded_batches(rows.sparkSession)
    return _fit(on_grid(rows.select(F.col(vector).alias("_v")), "_v"), components)


def _fit(gridded: DataFrame, components: int) -> Model | None:
    distinct = materialise(gridded.select("x").distinct(), "vectors", "snappy")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d, n = lengths[0]
    distinct = distinct.where(F.size("x") == d)
    # sums of long can pass a long's end
    cells = distinct.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("s"))
    sums = tuple(int(s) for _, s in sorted(cells.collect()))
    bare = Model(n, sums, np.zeros(0), np.zeros((0, len(sums))), None)
    values, vectors = jacobi(_covariance(distinct, n, bare.mean))
    model = Model(n, sums, values, vectors, None)
    k = min(components, model.kept)
    if not k:
        return model
    white = _covariance(distinct, n, model.mean, model.matrix[:k])
    return Model(n, sums, values, vectors, float(np.abs(white - np.eye(k)).max()))


WHITE = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _scored(held, components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        k = min(components, len(m.values))
        trace = m.values.sum()
        explained = [float(e / trace) if trace > 0 else 0.0 for e in m.values[:k]]
        for b in batches:
            x = _matrix(b.column("x"))
            white = (x - m.mean) @ m.matrix[:k].T
            cells = np.full((len(x), k), np.nan)
            cells[:, : white.shape[1]] = white
            row = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), pa.int32()),
                    pa.array(np.full(len(row), m.n), pa.int64()),
                    pa.array(m.deviation(x), pa.int64()).take(pa.array(row)),
                    pa.array(cells.reshape(-1), pa.float64(), from_pandas=True),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([m.identity_error] * len(row), pa.float64()),
                ],
                names=["vec_id", *[c.split()[0] for c in WHITE.split(", ")]],
            )

    return run


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each row with a vector and each of the first components: the whitened value, and the model's figures.

    whitened and identity_error are of the grid's units, where a component's variance is 1.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = rows.schema[key].dataType.simpleString()
    gridded = on_grid(rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("_v")), "_v").select("vec_id", "x")
    model = _fit(gridded, components)
    schema = f"vec_id {kind}, {WHITE}"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(model)
    gridded = gridded.where(F.size("x") == len(model.sums))
    return gridded.mapInArrow(_scored(held, components), schema)
