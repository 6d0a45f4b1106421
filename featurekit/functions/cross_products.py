"""Correlations of very many columns, in blocks of columns.

No task and not the driver holds a matrix of all pairs: each scan takes one block of columns
against all later ones, tasks add up a product per pair of blocks, Spark sums these by pair,
and the blocks stay in a table in the shared folder, from which the result's rows are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

# Columns of a block: a task holds a block times all columns.
BLOCK = 512

_PRODUCTS = "i int, j int, part int, cells binary"


def column_sums(cells: DataFrame, width: int, centre: np.ndarray | None = None) -> tuple[int, np.ndarray]:
    """Rows, and per column the sum of its values, or of squares around a centre. cells: a
    column ``x``, array<double>. A row per column comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            n += len(x)
            total += x.sum(axis=0) if centre is None else np.square(x - centre).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(total)], names=["c", "n", "total"]
        )

    summed = cells.mapInArrow(run, "c int, n long, total double").groupBy("c").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = summed.toArrow()
    out = np.zeros(width)
    out[found["c"].to_numpy()] = found["total"].to_numpy()
    return found["n"][0].as_py() if len(found) else 0, out


def _products(cells: DataFrame, i: int, width: int, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(i, j, part, cells): the products of block i with each block from i on."""
    starts = list(range(0, width, BLOCK))
    low, size = starts[i], BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((min(size, width - low), width - low))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[:, low:]
            z = (x - mean[low:]) * scale[low:]
            total += z[:, :size].T @ z
        parts = [np.ascontiguousarray(total[:, s - low : s - low + size]).tobytes() for s in starts[i:]]
        columns = [[i] * len(parts), list(range(i, len(starts))), [TaskContext.get().partitionId()] * len(parts)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns], pa.array(parts, pa.binary())], names=["i", "j", "part", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In the order of the parts, so a task run again gives the same bits.
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for j, part, data in zip(*(batch.column(c).to_pylist() for c in ("j", "part", "cells")), strict=True):
                held.setdefault(j, []).append((part, data))
        for j, parts in held.items():
            total = sum(np.frombuffer(data) for _, data in sorted(parts, key=lambda p: p[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                names=["i", "j", "part", "cells"],
            )

    return cells.mapInArrow(run, _PRODUCTS).repartition("j").mapInArrow(add, _PRODUCTS)


def correlation_blocks(cells: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(i, j, cells) for blocks i <= j with the correlations of their columns as bytes, written;
    and whether each column varies."""
    n, total = column_sums(cells, width)
    mean = total / max(n, 1)
    _, squares = column_sums(cells, width, mean)
    varies = squares > 0
    scale = np.divide(1.0, np.sqrt(squares), out=np.zeros(width), where=varies)
    spark, path = cells.sparkSession, shared_folder(cells.sparkSession)
    for i in range(-(-width // BLOCK)):
        _products(cells, i, width, mean, scale).write.mode("append").parquet(path)
    return spark.read.schema(_PRODUCTS).parquet(path).select("i", "j", "cells"), varies


def _block(i: int, j: int, data: bytes, varies: np.ndarray, size: int) -> np.ndarray:
    rows, columns = varies[i * size : (i + 1) * size], varies[j * size : (j + 1) * size]
    r = np.clip(np.frombuffer(data).reshape(len(rows), len(columns)), -1.0, 1.0)
    r[~rows] = np.nan
    r[:, ~columns] = np.nan
    if i == j:
        np.fill_diagonal(r, np.where(rows, 1.0, np.nan))
    return r


def correlation_rows(blocks: DataFrame, varies: np.ndarray, names: Sequence[str], undefined: float) -> DataFrame:
    """(feature_a, feature_b, r) of all pairs, made block by block."""
    names, size = np.array(names, object), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "cells")), strict=True):
                r = _block(i, j, data, varies, size)
                r = np.where(np.isnan(r), undefined, r)
                a, b = names[i * size : i * size + size], names[j * size : j * size + size]
                for left, right, m in ((a, b, r), (b, a, r.T))[: 1 if i == j else 2]:
                    columns = [np.repeat(left, len(right)), np.tile(right, len(left))]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c, pa.string()) for c in columns], pa.array(m.ravel())], names=["feature_a", "feature_b", "r"]
                    )

    return blocks.mapInArrow(run, "feature_a string, feature_b string, r double")


def correlation_array(blocks: DataFrame, varies: np.ndarray) -> np.ndarray:
    """The whole matrix on the driver, for what needs its inverse."""
    k = len(varies)
    out = np.full((k, k), np.nan)
    for row in blocks.toLocalIterator():
        r = _block(row["i"], row["j"], bytes(row["cells"]), varies, BLOCK)
        a, b = row["i"] * BLOCK, row["j"] * BLOCK
        out[a : a + r.shape[0], b : b + r.shape[1]] = r
        out[b : b + r.shape[1], a : a + r.shape[0]] = r.T
    return out
