"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers, x = floor(64 c) + 1000000. Each task subtracts a shift from
them and adds up sums and cross-products without rounding: blocks of rows go
through the floating-point matrix product only in limbs so short that every sum in
it stays below 2**53, and from there on numbers are Python integers of any length.
What a task found is cut into limbs of 30 bits, which Spark adds up by cell as
longs, so the partial results of any number of tasks merge exactly and before they
are shuffled. From S and XtX the driver forms n * XtX - S St, exactly, and only then
converts to float, over n squared, and decomposes by eigh: its table is dimension
squared, however many rows there are. Rows are then projected in tasks, and the
covariance of what was projected is measured in two further passes (means, then
centred products).

Defined results: a null vector, one with a null, NaN or infinite entry and an empty
one are dropped, as is a vector of another length than most of the table (ties: the
longer length). Entries beyond 2**56 count as that. A component whose eigenvalue is
zero to double precision has null `whitened` and is not part of `identity_error`. A
`deviation` beyond the largest long is null. Equal vectors have equal results;
one row, or only equal rows, give null `whitened` and zero `explained`. An empty table
gives an empty result. Other columns are kept by `whiten`, but for those that have a
result's name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.llm.shared import over_arrow, tidy

SCALE, OFFSET = 64, 1_000_000
#: Subtracted before products are formed; the result does not depend on it.
SHIFT = OFFSET
#: No scaled entry is larger, so that shifted ones fit a long.
LARGEST = 2.0**62
#: Rows of one product, and bits of a limb: sums stay below 2**53.
BLOCK_ROWS, LIMB = 4096, 20
#: Bits of the limbs that Spark adds up; 2**33 partial results cannot overflow a long.
CELL = 30


def shifted(v: pa.Array, dim: int) -> np.ndarray:
    """x - SHIFT of a batch of vectors without nulls, rows x dim."""
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    c = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), dim)
    return np.clip(np.floor(c * SCALE), -LARGEST, LARGEST).astype(np.int64) + (OFFSET - SHIFT)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limbs times powers of 2**LIMB; the last has the sign."""
    out, rest = [], y
    while np.abs(rest).max(initial=0) >= 1 << LIMB:
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


class Scatter:
    """n, sums and cross-products of integer rows, exact."""

    def __init__(self, dim: int):
        self.n = 0
        self.sums = np.zeros(dim, object)
        self.products = np.zeros((dim, dim), object)

    def add(self, y: np.ndarray) -> None:
        for a in range(0, len(y), BLOCK_ROWS):
            limbs = _limbs(y[a : a + BLOCK_ROWS])
            for i, left in enumerate(limbs):
                self.sums += left.sum(0).astype(np.int64).astype(object) * (1 << LIMB * i)
                for j, right in enumerate(limbs):
                    self.products += (left.T @ right).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
        self.n += len(y)

    def cells(self) -> Iterator[tuple[int, int]]:
        """(cell, value): n, the sums, and the products of i <= j."""
        dim = len(self.sums)
        yield 0, self.n
        for i in range(dim):
            yield 1 + i, self.sums[i]
            for j in range(i, dim):
                yield 1 + dim + i * dim + j, self.products[i, j]


def _cut(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) of a number; the last limb has the sign."""
    place = 0
    while not -(1 << CELL) <= value < 1 << CELL:
        yield place, value & ((1 << CELL) - 1)
        value >>= CELL
        place += 1
    yield place, value


def scatter(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and the upper half of XtX, exact, of the shifted rows (v)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Scatter(dim)
        for batch in batches:
            found.add(shifted(batch.column(0), dim))
        out = [(cell, place, limb) for cell, value in found.cells() for place, limb in _cut(int(value)) if limb] if found.n else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["cell", "place", "limb"])

    parts = rows.mapInArrow(run, "cell long, place int, limb long").groupBy("cell", "place").agg(F.sum("limb").alias("limb"))
    value: dict[int, int] = {}
    for r in parts.collect():  # dim squared cells of a few limbs
        value[r.cell] = value.get(r.cell, 0) + (r.limb << CELL * r.place)
    at = lambda c: value.get(c, 0)
    return at(0), [at(1 + i) for i in range(dim)], [[at(1 + dim + i * dim + j) if j >= i else 0 for j in range(dim)] for i in range(dim)]


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """(n XtX - S St) / n**2: integers up to the one division, which rounds correctly."""
    dim = len(sums)
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * products[i][j] - sums[i] * sums[j]) / (n * n)
    return v


def components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, unit eigenvectors (columns) and shares of the trace, by falling eigenvalue; the sign makes the largest entry positive."""
    e, a = np.linalg.eigh(v)
    e, a = np.maximum(e[::-1][:count], 0.0), a[:, ::-1][:, :count]
    a = a * np.where(a[np.abs(a).argmax(0), np.arange(a.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    return e, a, e / trace if trace > 0 else np.zeros(len(e))


def deviations(y: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """sum over dimensions of (n x - S)**2, exact; null beyond the largest long."""
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        z = y * n - np.array(sums, np.int64)
        rough = (z.astype(float) ** 2).sum(1)
        if rough.max(initial=0.0) < 2.0**62:
            return pa.array((z * z).sum(1))
        if rough.min() > 2.0**64:
            return pa.nulls(len(y), pa.int64())
    exact = ((y.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())


def usable(v: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: finite(x.cast("double")))


class Whitening:
    """What is fitted: n, S (shifted), directions scaled by the root of their eigenvalues, shares of the trace."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, count: int):
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.eigenvalues, self.directions, self.explained = components(v, count)
        self.real = self.eigenvalues > self.dim * np.finfo(float).eps * self.eigenvalues.max(initial=0.0)
        self.mean = np.array([s / n for s in sums])

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.real, 1.0 / np.sqrt(self.eigenvalues), np.nan)
        return ((y.astype(float) - self.mean) @ self.directions) * scale


def _summed(rows: DataFrame, model: Whitening, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(whitened rows), a flat array of bounded size, over all rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            part = of(model.project(shifted(batch.column(0), model.dim))[:, model.real])
            total = part if total is None else total + part
        total = np.zeros(0) if total is None else total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], names=["cell", "s"])

    got = rows.mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    return np.array([r.s for r in sorted(got, key=lambda r: r.cell)])


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' measured covariance less the identity."""
    k = int(model.real.sum())
    if not k:
        return 0.0
    mean = _summed(rows, model, lambda w: w.sum(0)) / model.n
    products = _summed(rows, model, lambda w: ((w - mean).T @ (w - mean)).ravel()).reshape(k, k) / model.n
    return float(np.abs(products - np.eye(k)).max())


def whiten(table: DataFrame, vector: str = "embedding", count: int = 32) -> DataFrame:
    """Usable rows of table with n, deviation, and arrays by component of `whitened` and `explained`, and `identity_error`."""
    names = ["n", "deviation", "whitened", "explained", "identity_error"]
    keep = [i for i, f in enumerate(table.schema.fields) if f.name.lower() not in names]
    at, fields = table.columns.index(vector), table.schema.fields
    v = F.col(f"`{vector}`")
    good = table.where(usable(v))
    sizes = good.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = T.StructType([*(fields[i] for i in keep), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if sizes is None:
        empty = table.sparkSession.createDataFrame([], schema)
        return empty.withColumns({"explained": F.array().cast("array<double>"), "identity_error": F.lit(0.0)})
    dim = sizes.dim
    good = good.where(F.size(v) == dim)
    rows = good.select(v.alias("v"))
    n, sums, products = scatter(rows, dim)
    model = Whitening(n, sums, covariance(n, sums, products), count)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = shifted(batch.column(at), model.dim)
            w = model.project(y)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(w.shape[1], 1), dtype=np.int32)), flat)
            new = [pa.array(np.full(len(y), model.n)), deviations(y, model.n, model.sums), whitened]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], names=schema.names)

    out = over_arrow(good, run, schema)
    return out.withColumns({"explained": F.lit([float(x) for x in model.explained]), "identity_error": F.lit(identity_error(rows, model))})
