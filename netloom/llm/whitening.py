"""Whitened embeddings: projections on the leading components of the covariance, each with unit variance.

Entries become whole numbers on a grid, so counts, sums and cross products are exact whatever the order in
which Spark adds them. The covariance is that of the *different* vectors: copies are merged where they are
read and again after the shuffle, and the merged list is written once. Each task adds up the cross products
of its rows about a common whole-number centre; what meets on the driver is one row of sums for each pair of
dimensions. :mod:`spectrum` finds the components there. Rows are then projected where they are read.

Defined results: rows whose vector is NULL or empty or holds a NULL or a value that is not finite are left
out; the dimension is the length that most of the different vectors have (the larger among equals), and rows
of another length are left out too; grid numbers end at 10**15 on either side; repeated rows and NULL
identifiers are returned as often as they come; a component whose variance is nothing but rounding (fewer
different vectors than components, constant dimensions) cannot be scaled and is not returned, so one single
vector or an empty table gives no rows; a deviation beyond a long is NULL; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm import common, spectrum
from netloom.session import stage

_EDGE = 10**15
_EXACT = 1 << 53  # whole numbers up to here are exact as doubles
_SUM = pa.decimal128(38, 0)


def grid(vector: Column, scale: float, origin: int) -> Column:
    """Whole numbers of a vector's entries; NULL for a vector that cannot be used."""
    entries = F.transform(vector, lambda c: c.cast("double") * scale)
    usable = (F.size(vector) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c, F.lit(float(_EDGE))), F.lit(-float(_EDGE)))) + origin)
    return F.when(usable, whole)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact cross products of whole-number rows; in doubles where these are exact."""
    most = int(np.abs(y).max())
    if most * most * len(y) < _EXACT:
        rows = y.astype(float)
        return (rows.T @ rows).astype(np.int64).astype(object)
    rows = y.astype(object)
    return rows.T.dot(rows)


class Moments:
    """Number, per-dimension sums and covariance of a written list of grid vectors (column ``x``)."""

    def __init__(self, vectors: DataFrame, dimension: int):
        self.vectors, self.dimension = vectors, dimension
        self.n, self.sums = self._sums()
        self.centre = [round(s / self.n) if abs(s) < _EXACT else s // self.n for s in self.sums] if self.n else []
        self.rest = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)] if self.n else []

    def _sums(self) -> tuple[int, list[int]]:
        d = self.dimension

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(d, dtype=object)
            for batch in batches:
                for part in common.pieces_of([batch], common.BATCH_ROWS):
                    n += part.num_rows
                    total = total + _matrix(part.column(0), d).sum(axis=0).astype(object)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(-1, d)), pa.array([Decimal(int(v)) for v in [n, *total]], _SUM)], ["i", "v"])

        found = {r["i"]: int(r["v"]) for r in self.vectors.select("x").mapInArrow(added, "i long, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        return found.get(-1, 0), [found.get(i, 0) for i in range(d)]

    def covariance(self) -> np.ndarray:
        """Covariance with divisor n. Rows are centred on whole numbers first; what the centre misses is taken out exactly."""
        d, centre = self.dimension, np.array(self.centre, dtype=np.int64)
        lower = np.tril_indices(d)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for part in common.pieces_of([batch], common.BATCH_ROWS):
                    products = _products(_matrix(part.column(0), d) - centre)[lower]
                    total = products if total is None else total + products
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lower[0]), pa.array(lower[1]), pa.array([Decimal(int(v)) for v in total], _SUM)], ["i", "j", "v"])

        rows = self.vectors.select("x").mapInArrow(added, "i long, j long, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        out, n = np.zeros((d, d)), self.n
        for i, j, v in rows:
            out[i, j] = out[j, i] = (n * int(v) - self.rest[i] * self.rest[j]) / (n * n)
        return out


def _projector(moments: Moments, values: np.ndarray, vectors: np.ndarray):
    """Whitened projections of grid rows."""
    centre, shift = np.array(moments.centre, dtype=np.int64), np.array([r / moments.n for r in moments.rest])
    weights = vectors / np.sqrt(values)
    return lambda x: ((x - centre).astype(float) - shift) @ weights


def identity_error(moments: Moments, project, components: int) -> float:
    """Largest absolute entry of the measured covariance of the whitened list minus the identity."""
    d = moments.dimension

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            if batch.num_rows:
                w = project(_matrix(batch.column(0), d))
                sums += w.sum(axis=0)
                products += w.T @ w
        i, j = np.indices(products.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(components, -1), i])), pa.array(np.concatenate([np.arange(components), j])),
             pa.array(np.concatenate([sums, products.ravel()]))], ["i", "j", "v"])

    rows = moments.vectors.select("x").mapInArrow(added, "i long, j long, v double").groupBy("i", "j").agg((F.sum("v") / moments.n).alias("v")).collect()
    mean, second = np.zeros(components), np.zeros((components, components))
    for i, j, v in rows:
        if i < 0:
            mean[j] = v
        else:
            second[i, j] = v
    return float(np.abs(second - np.outer(mean, mean) - np.eye(components)).max())


def _deviations(x: np.ndarray, n: int, centre: list[int], rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2, exact, where S is n times the centre and the rest."""
    y = x - np.array(centre, dtype=np.int64)
    most = n * int(np.abs(y).max()) + max(map(abs, rest))
    if most * most * x.shape[1] < 1 << 63:
        t = y * n - np.array(rest, dtype=np.int64)
        return np.einsum("ij,ij->i", t, t).tolist()
    t = y.astype(object) * n - np.array(rest, dtype=object)
    return [int(v) if v < 1 << 63 else None for v in (t * t).sum(axis=1)]


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = 16, scale: float = 64.0, origin: int = 1_000_000, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable row and component: identifier, component, n, deviation, whitened, explained, identity_error."""
    common.tune(rows.sparkSession)
    spark, kind = rows.sparkSession, rows.schema[ident].dataType.simpleString()
    schema = f"`{ident}` {kind}, {_OUT}"
    usable = rows.select(F.col(ident), grid(F.col(vector), scale, origin).alias("x")).where("x is not null")
    fit = stage(usable.select("x").distinct(), "fit-list")
    sizes = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0]["d"]
    moments = Moments(fit.where(F.size("x") == d), d)
    covariance = moments.covariance()
    trace = float(np.trace(covariance))
    values, vectors = spectrum.leading(covariance, components)
    real = values > 1e-12 * trace
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    project, k = _projector(moments, values, vectors), len(values)
    error, explained = identity_error(moments, project, k), values / trace
    n, centre, rest = moments.n, moments.centre, moments.rest

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces_of(batches, common.BATCH_ROWS):
            if part.num_rows:
                x, m = _matrix(part.column("x"), d), part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(ident).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     pa.array(_deviations(x, n, centre, rest), pa.int64()).take(each), pa.array(project(x).ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    [ident, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.where(F.size("x") == d).select(ident, "x").mapInArrow(projected, schema)
