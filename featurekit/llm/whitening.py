"""Whitening of vectors by an incremental eigendecomposition.

Every task keeps the spectrum of the centred rows it has read: count, sums, eigenvalues and
eigenvectors of their scatter. Rows arrive folded: about ``FOLD`` rows per dimension are
centred and reduced by a QR factorisation to at most as many rows as dimensions with the same
scatter. Each of these is a rank-one update, and so is the step between the means: after
deflation of directions that the update does not change, the new eigenvalues are the roots
of the secular equation, and the eigenvectors follow from the roots (Gu and Eisenstat).
Spectra of tasks are merged in a tree, again by rank-one updates along the other's
eigenvectors. A last pass projects the exactly centred rows on the basis found and solves the
small projected problem (Rayleigh-Ritz), which removes what the updates have lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurekit.llm.tables import written

COMPONENTS = 32
#: Rows folded together, per dimension.
FOLD = 16
#: Spectra that one task merges.
FAN_IN = 16
#: Directions whose eigenvalue is below this share of the greatest hold rounding errors only.
NEGLIGIBLE = 1e-13

_SPECTRUM = "part long, dimension int, n long, sums array<long>, values array<double>, basis array<double>"


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z', for rising distinct d and no zero in z.

    Each root lies between two poles. It is returned as the nearer pole's number and the
    distance from it, so that differences to all poles keep their digits."""
    k = len(d)
    squares = z * z
    gap = np.append(np.diff(d), squares.sum())
    at = np.arange(k)
    # The sign half-way tells the nearer pole; the last root is measured from the last pole.
    offset = d[:, None] - d[None, :]  # offset[j, i] = d_j - d_i
    middle = 1 + (squares[:, None] / (offset - gap / 2)).sum(axis=0)
    right = (middle < 0) & (at < k - 1)
    origin = np.where(right, at + 1, at)
    low = np.where(right, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    high = np.where(right, 0.0, np.where(middle < 0, gap, gap / 2))
    poles = d[:, None] - d[origin][None, :]
    below = at[:, None] <= at[None, :]  # poles left of the root
    x, going = (low + high) / 2, np.ones(k, bool)
    for _ in range(100):
        terms = poles - x
        parts = squares[:, None] / terms
        slopes = parts / terms
        left, over = np.where(below, parts, 0.0).sum(axis=0), np.where(below, 0.0, parts).sum(axis=0)
        f = 1 + left + over
        rough = np.abs(f) > 4 * np.finfo(float).eps * k * (1 + np.abs(left) + np.abs(over))
        if not (rough & going).any():
            break
        low, high = np.where(f < 0, np.maximum(low, x), low), np.where(f > 0, np.minimum(high, x), high)
        # Both sides become one pole each with the same value and slope; their sum's root is next.
        one, two = terms[at, at], np.append(terms[at[1:], at[:-1]], np.inf)
        left_slope, over_slope = np.where(below, slopes, 0.0).sum(axis=0), np.where(below, 0.0, slopes).sum(axis=0)
        s, r = left_slope * one * one, left - left_slope * one
        with np.errstate(all="ignore"):
            far = np.isfinite(two)
            t = np.where(far, over_slope * two * two, 0.0)
            c = 1 + r + np.where(far, over - over_slope * two, over)
            # c + s / (one - y) + t / (two - y) = 0 for the step y.
            p = np.where(far, c * (one + two) + s + t, c * one + s)
            q = np.where(far, c * one * two + s * two + t * one, 0.0)
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0.0))
            step = np.where(far, np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c)), p / c)
        y = x + step
        y = np.where(np.isfinite(y) & (((y > low) & (y < high)) | (y == x)), y, (low + high) / 2)
        going &= rough & (np.abs(y - x) > np.finfo(float).eps * np.abs(x))
        x = np.where(going, y, x)
    return origin, x


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of basis diag(values) basis' + v v', values rising, vectors in columns."""
    z = basis.T @ v
    norm = float(z @ z)
    if norm == 0.0:
        return values, basis
    least = 8 * np.finfo(float).eps * max(abs(values[-1]), norm)
    values, basis, z = values.copy(), basis.copy(), z.copy()
    # Deflation: directions that v hardly touches stay; of two equal eigenvalues one direction
    # can be turned so that v has no part in it.
    live = np.abs(z) * np.sqrt(norm) > least
    previous = -1
    for j in np.flatnonzero(live):
        if previous >= 0:
            r = np.hypot(z[previous], z[j])
            c, s = z[j] / r, z[previous] / r
            if abs((values[j] - values[previous]) * c * s) <= least:
                basis[:, [previous, j]] = basis[:, [previous, j]] @ np.array([[c, s], [-s, c]])
                a, b = values[previous], values[j]
                values[previous], values[j] = a * c * c + b * s * s, a * s * s + b * c * c
                z[previous], z[j] = 0.0, r
                live[previous] = False
        previous = j
    kept = np.flatnonzero(live)
    kept = kept[np.argsort(values[kept], kind="stable")]
    if len(kept):
        d, w = values[kept], z[kept]
        origin, x = secular_roots(d, w)
        apart = (d[:, None] - d[origin][None, :]) - x  # d_i - root_k
        # The z for which these roots are exact.
        between = d[:, None] - d[None, :]
        np.fill_diagonal(between, 1.0)
        ratio = apart / between.T  # (d_i - root_k) / (d_k - d_i) up to sign
        np.fill_diagonal(ratio, np.diag(apart))
        w = np.copysign(np.sqrt(np.abs(ratio.prod(axis=1))), w)
        turn = w[:, None] / apart
        turn /= np.sqrt((turn * turn).sum(axis=0))
        basis[:, kept] = basis[:, kept] @ turn
        values[kept] = d[origin] + x
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, exact sums, and the eigenvalues and eigenvectors of the centred scatter of rows
    of whole numbers."""

    def __init__(self, dimension: int):
        self.n, self.sums = 0, np.zeros(dimension, object)
        self.values, self.basis = np.zeros(dimension), np.eye(dimension)

    def _shift(self, n: int, sums: np.ndarray) -> None:
        """Take in the distance between both means, then the other's count and sums."""
        if self.n and n:
            between = np.array([float(a * n - b * self.n) for a, b in zip(self.sums, sums, strict=True)])
            scale = np.sqrt(1.0 / (float(n) * float(self.n) * float(n + self.n)))
            self.values, self.basis = rank_one(self.values, self.basis, between * scale)
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, rows: np.ndarray) -> None:
        """Rows of whole numbers (int64)."""
        if not len(rows):
            return
        base = rows[0].copy()
        near = rows - base
        total = near.sum(axis=0)
        centred = (near * len(rows) - total) / len(rows)
        for row in np.linalg.qr(centred, mode="r"):
            self.values, self.basis = rank_one(self.values, self.basis, row)
        self._shift(len(rows), total.astype(object) + base.astype(object) * len(rows))

    def merge(self, n: int, sums: np.ndarray, values: np.ndarray, basis: np.ndarray) -> None:
        for value, vector in zip(values, basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, np.sqrt(value) * vector)
        self._shift(n, sums)

    def row(self, part: int) -> tuple:
        return part, len(self.values), self.n, [int(s) for s in self.sums], self.values.tolist(), self.basis.ravel().tolist()


def _entries(batch: pa.RecordBatch, scale: float | None, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension, the numbers of the rows whose vectors take part, and their whole numbers."""
    column = batch.column("vector")
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = column.flatten(), np.cumsum(size)
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(flat.type) and scale is None:
        numbers = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + base
    else:
        cells = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        cells = np.floor(cells * (1 if scale is None else scale))
        known = known & (np.abs(cells) < 2.0**62)  # false for NaN
        numbers = np.where(known, cells, 0).astype(np.int64) + base
    bad = np.append(0, np.cumsum(~known))
    whole = (size > 0) & (bad[ends] == bad[ends - size])
    for d in np.unique(size[whole]):
        rows = np.flatnonzero(whole & (size == d))
        yield rows, numbers[(ends[rows] - d)[:, None] + np.arange(d)]


class _Vectors:
    """A table (vec_id, vector) and how its entries become whole numbers."""

    def __init__(self, table: DataFrame, scale: float | None, base: int):
        self.table, self.scale, self.base = table, scale, base

    def entries(self, dimension: int | None = None):
        scale, base = self.scale, self.base

        def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            return (x for x in _entries(batch, scale, base) if dimension is None or x[1].shape[1] == dimension)

        return read


def _spectra(read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, Spectrum] = {}
        waiting: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in read(batch):
                d = matrix.shape[1]
                held = np.concatenate([waiting[d], matrix]) if d in waiting else matrix
                spectrum = found.setdefault(d, Spectrum(d))
                whole = len(held) // (FOLD * d) * FOLD * d
                for at in range(0, whole, FOLD * d):
                    spectrum.add(held[at : at + FOLD * d])
                waiting[d] = held[whole:]
        for d, rest in waiting.items():
            found[d].add(rest)
        if found:
            yield _batch([s.row(TaskContext.get().partitionId()) for s in found.values()])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = [f.split()[0] for f in _SPECTRUM.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """Spectra of one dimension, in order of their parts, as one."""
    group = group.sort_values("part")
    d = int(group["dimension"].iloc[0])
    spectrum = Spectrum(d)
    for row in group.itertuples():
        basis = np.asarray(row.basis).reshape(d, d)
        if spectrum.n:
            spectrum.merge(int(row.n), np.array([int(s) for s in row.sums], object), np.asarray(row.values), basis)
        else:
            spectrum.n, spectrum.sums = int(row.n), np.array([int(s) for s in row.sums], object)
            spectrum.values, spectrum.basis = np.array(row.values), basis.copy()
    columns = [f.split()[0] for f in _SPECTRUM.split(", ")]
    return pd.DataFrame([spectrum.row(int(group["part"].iloc[0]) // FAN_IN)], columns=columns)


def _sum_of_products(vectors: _Vectors, project, dimension: int, size: int) -> np.ndarray:
    """Sum over all rows of p p', for p the row's ``size`` projections: one matrix per task,
    added up by Spark; size * size numbers come to the driver."""

    read = vectors.entries(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for _, matrix in read(batch):
                p = project(matrix)
                total += p.T @ p
        cell = np.flatnonzero(np.triu(np.ones((size, size))))
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total.ravel()[cell])], names=["cell", "total"])

    sums = vectors.table.select("vector").mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(size * size)
    out[sums["cell"].to_numpy()] = sums["total"].to_numpy()
    out = out.reshape(size, size)
    return out + np.triu(out, 1).T


class Whitening:
    """What a fit has learned: n, sums, eigenvalues (falling) and eigenvectors (rows)."""

    def __init__(self, n: int, sums: list[int], trace: float, values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.trace, self.values, self.vectors = n, sums, trace, values, vectors

    def centred(self, matrix: np.ndarray) -> np.ndarray:
        """x - mean, from exact numbers: n (x - b) - (S - n b) is a whole number for b near the mean."""
        return self.parted(matrix) / self.n

    def parted(self, matrix: np.ndarray) -> np.ndarray:
        """n x - S as whole numbers; as Python's where 64 bits do not hold them."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s - int(b) * self.n for s, b in zip(self.sums, base, strict=True)], object)
        near = matrix - base
        if int(np.abs(near).max(initial=0) + 1) * self.n < 2**62:
            return near * self.n - rest.astype(np.int64)
        return near.astype(object) * self.n - rest

    def deviations(self, matrix: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exactly; null where a long does not hold it."""
        parted = self.parted(matrix)
        if parted.dtype != object and (parted.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0) < 2.0**62:
            return (parted * parted).sum(axis=1).tolist()
        exact = [sum(int(x) ** 2 for x in row) for row in parted]
        return [x if x < 2**63 else None for x in exact]

    def whitened(self, matrix: np.ndarray, components: int) -> np.ndarray:
        """Projections over the root of their variance; NaN for directions without any."""
        values = self.values[:components]
        scale = np.where(values > NEGLIGIBLE * self.values[0], np.sqrt(np.maximum(values, 0.0)), np.nan)
        return (self.centred(matrix).astype(np.float64) @ self.vectors[:components].T) / scale


def fit(vectors: _Vectors) -> Whitening | None:
    """The eigendecomposition of the covariance (divisor n) of the vectors. The commonest
    length counts (ties: the longer one); None without any row."""
    parts = written(vectors.table.select("vector").mapInArrow(_spectra(vectors.entries()), _SPECTRUM))
    sizes = parts.groupBy("dimension").agg(F.sum("n").alias("n"), F.max("part").alias("last")).collect()
    if not sizes:
        return None
    size = max(sizes, key=lambda r: (r["n"], r["dimension"]))
    d, last = size["dimension"], size["last"]
    parts = parts.where(F.col("dimension") == d)
    while last > 0:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(_merged, _SPECTRUM)
        last //= FAN_IN
        if last > 0:
            parts = written(parts)
    row = parts.first()
    basis = np.array(row["basis"]).reshape(d, d)
    model = Whitening(row["n"], [int(s) for s in row["sums"]], 0.0, np.zeros(d), basis.T)
    centred = model.centred

    def project(matrix: np.ndarray) -> np.ndarray:
        return centred(matrix).astype(np.float64) @ basis

    covariance = _sum_of_products(vectors, project, d, d) / model.n
    values, turn = np.linalg.eigh(covariance)
    model.trace = float(np.trace(covariance))
    model.values, model.vectors = np.maximum(values[::-1], 0.0), (basis @ turn[:, ::-1]).T
    # The same sign in every run: the entry of greatest size is positive.
    peak = np.abs(model.vectors).argmax(axis=1)
    model.vectors = model.vectors * np.sign(model.vectors[np.arange(d), peak])[:, None]
    return model


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    *,
    scale: float | None = None,
    base: int = 0,
    vec_id: str = "vec_id",
    vector: str = "vector",
) -> DataFrame:
    """Whitened vectors, one row per vector and component: vec_id, component (from 1, by
    falling eigenvalue), n (vectors taken), deviation (the sum over dimensions of (n x - S)^2, S the
    sums; null where a long does not hold it), whitened, explained (the eigenvalue's share of all), and
    identity_error (of all whitened vectors: the greatest entry of their covariance minus the identity).

    vector: array of numbers; entry c becomes the whole number x = floor(scale * c) + base, computed
    in double precision, so that sums and means are exact. Null and empty vectors and those that
    hold a null, an entry that is not finite or one beyond 2^62 take no part, nor do those of another
    length than the commonest (ties: the longer). Repeated rows count as often as they stand; a null
    id stays null. Directions in which all vectors agree have null in whitened and take no part in
    identity_error; if there is no other, that is null, and explained too where nothing varies. An
    empty table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    table = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    read = _Vectors(table, scale, base)
    model = fit(read)
    if model is None:
        return spark.createDataFrame([], _WHITE)
    d = len(model.values)
    shown = min(components, d)
    varied = int((model.values[:shown] > NEGLIGIBLE * model.values[0]).sum()) if model.values[0] > 0 else 0
    error = None
    if varied:
        products = _sum_of_products(read, lambda m: model.whitened(m, varied), d, varied)
        error = float(np.abs(products / model.n - np.eye(varied)).max())
    entries = read.entries(d)
    share = (model.values[:shown] / model.trace).tolist() if model.trace > 0 else [None] * shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in entries(batch):
                ids = batch.column("vec_id").take(pa.array(rows))
                at = pa.array(np.repeat(np.arange(len(rows)), shown))
                white = np.full((len(rows), shown), np.nan)
                white[:, :varied] = model.whitened(matrix, varied) if varied else 0.0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(at),
                        pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(rows))),
                        pa.array(model.deviations(matrix), pa.int64()).take(at),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(share * len(rows), pa.float64()),
                    ],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    found = table.mapInArrow(run, "vec_id long, component int, deviation long, whitened double, explained double")
    return found.select(
        "vec_id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
