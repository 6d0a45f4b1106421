"""Exact quantiles of many columns without sorting or shuffling the rows.

One aggregation makes a quantile sketch per column. Its values bracket every wanted rank;
the next one counts the rows between the brackets and, inside them, the rows per distinct
value. Both combine on the map side, so a value held by a third of all rows costs one
entry. Brackets expected to hold too many values for the driver are sketched again (each
time they shrink about a hundredfold). The counts decide, never the sketch: results are
exact order statistics, interpolated linearly.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_double, col
from .bins import double_array, double_sql, with_bin_number

ACCURACY = 10_000
COLLECT_LIMIT = 1_000_000
COLUMNS_PER_JOB = 16
_CELLS = 200
_MAX_ROUNDS = 40


def column_chunks(columns: Sequence[str], size: int = COLUMNS_PER_JOB) -> list[list[str]]:
    """Columns in groups small enough for compiled code; each is scanned once."""
    return [list(columns[i : i + size]) for i in range(0, len(columns), size)]


def _grid(probs: Sequence[float]) -> list[float]:
    slack = 2.0 / ACCURACY
    points = {0.0, 1.0}
    for p in probs:
        points |= {max(0.0, p - slack), min(1.0, p + slack)}
    return sorted(points)


def sketch_aggregates(columns: Sequence[str], probs: Sequence[float]) -> list[Column]:
    """Per column (double, null for missing): rows, least, greatest and sketch."""
    out = []
    for i, name in enumerate(columns):
        x = col(name)
        out += [
            F.count(x).alias(f"__n{i}"),
            F.min(x).alias(f"__lo{i}"),
            F.max(x).alias(f"__hi{i}"),
            F.percentile_approx(x, _grid(probs), ACCURACY).alias(f"__grid{i}"),
        ]
    return out


def _position(n: int, prob: float) -> tuple[int, float]:
    h = (n - 1) * (prob * 100 / 100)
    low = min(math.floor(h), n - 1)
    return low, h - low


class _Column:
    """Search state of one column: ranks still open and the bracket of each."""

    def __init__(self, n: int, low: float, high: float):
        self.n, self.low, self.high = n, low, high
        self.known: dict[int, float] = {}
        self.brackets: dict[int, tuple[float, float, float]] = {}

    def start(self, probs: Sequence[float], grid_values: Sequence[float]) -> None:
        grid = list(zip(_grid(probs), grid_values))
        ranks = set()
        for p in probs:
            rank, _ = _position(self.n, p)
            ranks |= {rank, min(rank + 1, self.n - 1)}
        for rank in ranks:
            if rank == 0 or self.low == self.high:
                self.known[rank] = self.low
            elif rank == self.n - 1:
                self.known[rank] = self.high
            else:
                self._bracket(rank, grid, 0, self.n, self.low, self.high)

    def _bracket(self, rank, grid, base, size, low, high) -> None:
        slack = size / ACCURACY + 1
        low_p, high_p = 0.0, 1.0
        for p, value in grid:
            if base + p * size + slack <= rank and value >= low:
                low, low_p = value, p
            if base + p * size - slack >= rank and value <= high:
                high, high_p = value, p
                break
        self.brackets[rank] = (low, high, (high_p - low_p) * size)

    def refine(self, rank: int, base: int, size: int, low, high, values) -> None:
        grid = [(i / _CELLS, v) for i, v in enumerate(values or ())]
        self._bracket(rank, grid, base, size, low, high)

    def cuts(self) -> list[float]:
        return sorted({e for low, high, _ in self.brackets.values() for e in (low, high)})

    def wanted(self, cuts: Sequence[float]) -> set[int]:
        """Codes (2i: open interval before cut i, 2i+1: cut i) of the open intervals
        that lie in a bracket."""
        out = set()
        for low, high, _ in self.brackets.values():
            out |= {2 * i for i in range(bisect_left(cuts, low) + 1, bisect_left(cuts, high) + 1)}
        return out

    def expected(self) -> float:
        return sum(size for _, _, size in self.brackets.values())


def _coded(df: DataFrame, columns: Mapping[int, str], state: Mapping[int, _Column]) -> DataFrame:
    """Rows (c, code, v): column number, position between the cuts, and the value where
    it lies in a bracket."""
    df = df.select([col(name) for name in columns.values()])
    entries = []
    for i, name in columns.items():
        cuts = state[i].cuts()
        df = with_bin_number(df, f"__below{i}", name, cuts)
        below = F.col(f"__below{i}")
        next_cut = F.get(double_array(cuts), below)
        code = below * 2 + F.when(next_cut == col(name), 1).otherwise(0)
        wanted = sorted(state[i].wanted(cuts))
        inside = code.isin(wanted) if wanted else F.lit(False)
        entries.append(
            F.struct(
                F.lit(i).alias("c"), code.alias("code"), F.when(inside, col(name)).alias("v")
            )
        )
    return df.select(F.inline(F.array(entries))).where(F.col("code").isNotNull())


def long_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, x): one row per cell of some columns (double), numbered in their order."""
    cells = [F.struct(F.lit(i).alias("c"), as_double(df, name).alias("x")) for i, name in enumerate(columns)]
    return df.select(F.inline(F.array(*cells)))


def _coded_long(rows: DataFrame, open_columns: Mapping[int, str], state: Mapping[int, _Column]) -> DataFrame:
    """The same as ``_coded`` from rows (c, x): cuts and wanted codes are literals per column."""
    last = max(open_columns)
    cuts = [state[i].cuts() if i in open_columns else [] for i in range(last + 1)]
    wanted = [sorted(state[i].wanted(cuts[i])) if i in open_columns else [] for i in range(last + 1)]
    ends = ", ".join(f"CAST(array({', '.join(map(double_sql, c))}) AS array<double>)" for c in cuts)
    codes = ", ".join(f"CAST(array({', '.join(map(str, w))}) AS array<int>)" for w in wanted)
    rows = rows.where(F.col("c").isin(list(open_columns)) & F.col("x").isNotNull())
    rows = rows.withColumn("cuts", F.get(F.expr(f"array({ends})"), F.col("c")))
    x = F.col("x")
    rows = rows.withColumn("below", F.aggregate("cuts", F.lit(0), lambda n, cut: n + (cut < x).cast("int")))
    code = F.col("below") * 2 + F.when(F.get("cuts", "below") == x, 1).otherwise(0)
    inside = F.array_contains(F.get(F.expr(f"array({codes})"), F.col("c")), F.col("code"))
    return rows.select("c", code.alias("code"), "x").select("c", "code", F.when(inside, x).alias("v"))


def _sketched(coded: DataFrame) -> DataFrame:
    """Rows per (c, code), with the range and a sketch of the values that were read. Sketches of
    many groups sort their rows, so the rows without a value, most of them, are counted apart."""
    n, read = F.count(F.lit(1)).alias("n"), F.col("v").isNotNull()
    cells = [i / _CELLS for i in range(_CELLS + 1)]
    inside = coded.where(read).groupBy("c", "code").agg(
        n, F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", cells, ACCURACY).alias("grid")
    )
    outside = coded.where(~read).groupBy("c", "code").agg(n)
    return inside.unionByName(outside, allowMissingColumns=True)


def _step(coded: DataFrame, open_columns: Mapping[int, str], state: Mapping[int, _Column]) -> None:
    if sum(state[i].expected() for i in open_columns) <= COLLECT_LIMIT:
        found = coded.groupBy("c", "code", "v").agg(F.count(F.lit(1)).alias("n"))
    else:
        found = _sketched(coded)
    table = found.toArrow()
    number = table["c"].to_numpy()
    for i in open_columns:
        _settle(state[i], table.filter(pa.array(number == i)))


def _settle(column: _Column, table: pa.Table) -> None:
    """Find the open ranks among the counted values and intervals of one column."""
    cuts, ranks = column.cuts(), sorted(column.brackets)
    column.brackets = {}
    read = "v" in table.column_names
    if read:
        order = np.lexsort((table["v"].to_numpy(), table["code"].to_numpy()))
    else:
        order = np.argsort(table["code"].to_numpy())
    table = table.take(pa.array(order))
    code, upto = table["code"].to_numpy(), np.cumsum(table["n"].to_numpy())
    for rank, at in zip(ranks, np.searchsorted(upto, ranks, side="right")):
        slot = int(code[at]) // 2
        if code[at] % 2:
            column.known[rank] = cuts[slot]
            continue
        if read and table["v"][at].is_valid:
            column.known[rank] = table["v"][at].as_py()
            continue
        # Values of this interval were not read: it becomes the bracket.
        size = table["n"][at].as_py()
        low = cuts[slot - 1] if slot else column.low
        high = cuts[slot] if slot < len(cuts) else column.high
        grid = None
        if not read and table["low"][at].is_valid:
            low, high, grid = (table[c][at].as_py() for c in ("low", "high", "grid"))
        if low == high:
            column.known[rank] = low
        else:
            column.refine(rank, int(upto[at]) - size, size, low, high, grid)


def resolve_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    sketches: Mapping[str, Any],
    long: bool = False,
) -> dict[str, list[float] | None]:
    """Finish what ``sketch_aggregates`` began: column -> its exact quantiles, None for a
    column without values. The columns must be doubles with null for missing; ``long``: df has
    rows (c, x) of ``long_rows``."""
    state: dict[int, _Column] = {}
    for i, _ in enumerate(columns):
        n = sketches[f"__n{i}"]
        if n:
            state[i] = _Column(n, sketches[f"__lo{i}"], sketches[f"__hi{i}"])
            state[i].start(probs, sketches[f"__grid{i}"])
    for _ in range(_MAX_ROUNDS):
        if not any(s.brackets for s in state.values()):
            break
        open_columns = {i: columns[i] for i in state if state[i].brackets}
        coded = (_coded_long if long else _coded)(df, open_columns, state)
        _step(coded, open_columns, state)
    else:
        raise RuntimeError("quantile search did not converge")
    out: dict[str, list[float] | None] = {}
    for i, name in enumerate(columns):
        if i not in state:
            out[name] = None
            continue
        values = []
        for p in probs:
            rank, weight = _position(state[i].n, p)
            a = state[i].known[rank]
            b = state[i].known[min(rank + 1, state[i].n - 1)]
            if a == b:
                values.append(a)
            elif weight < 0.5:
                values.append(a + (b - a) * weight)
            else:
                values.append(b - (b - a) * (1 - weight))
        out[name] = values
    return out


def long_sketches(rows: DataFrame, probs: Sequence[float]) -> dict[str, Any]:
    """What ``sketch_aggregates`` gives, from rows (c, x): one scan and a row per column."""
    found = rows.groupBy("c").agg(*sketch_aggregates(["x"], probs)).collect()
    return {f"{name[:-1]}{r['c']}": r[name] for r in found for name in r.asDict() if name != "c"}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float] | None]:
    """Quantiles with linear interpolation at (n-1)p, missing values left out. More columns
    than compiled code can hold are read as rows, so they share their scans too."""
    if len(columns) > COLUMNS_PER_JOB:
        rows = long_rows(df, columns)
        return resolve_quantiles(rows, columns, probs, long_sketches(rows, probs), long=True)
    out: dict[str, list[float] | None] = {}
    for chunk in column_chunks(columns):
        part = df.select([as_double(df, name) for name in chunk])
        sketches = part.agg(*sketch_aggregates(chunk, probs)).first()
        out |= resolve_quantiles(part, chunk, probs, sketches)
    return out
