"""Running totals along an order, and exact "first n rows" cutoffs.

Nothing here sorts a whole table in one task: rows are cut into value ranges whose
bounds are plain literals (so a recomputed task sees the same ranges), each range is
ordered by itself, and range totals, at most one row per range, shift the sums.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import col
from .bins import double_array, with_bin_number

MAX_RANGES = 2048
COLLECT_LIMIT = 20_000


def range_bounds(sketch: Sequence[float], highest: float) -> list[float]:
    """Upper ends of the value ranges: the sketch's values, closed by the maximum."""
    return sorted({*map(float, sketch), float(highest)})


def range_count(df: DataFrame) -> int:
    """Ranges to cut: some per shuffle partition so that they spread evenly."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_RANGES, 4 * partitions))


def running_totals(
    rows: DataFrame, groups: DataFrame, key: str, values: Sequence[str], bounds: Sequence[float]
) -> DataFrame:
    """Totals from the greatest key downwards.

    ``groups`` holds one row per distinct key; ``rows`` the data it was counted from, with
    the same value columns, used for the range totals without counting the groups twice.
    Adds for every value column v: ``cum_v`` (total including this key) and ``next_v`` (v
    of the next lower key, null at the lowest). Ranges are right-closed and end on keys
    that occur, so the first key of the range below is the range's bound itself.
    """
    part = "__range"
    inner = bounds[:-1]
    totals_of = with_bin_number(rows, part, key, inner)
    top = F.get(double_array(bounds), F.col(part))
    per_range = {
        r[part]: r
        for r in totals_of.groupBy(part)
        .agg(
            F.count_if(col(key) == top).alias("tops"),
            *[F.sum(col(v)).alias(f"t{i}") for i, v in enumerate(values)],
            *[
                F.sum(F.when(col(key) == top, col(v)).otherwise(0)).alias(f"n{i}")
                for i, v in enumerate(values)
            ],
        )
        .collect()
    }
    if not all(r["tops"] for r in per_range.values()):
        raise ValueError("every bound must be a key that occurs")
    order = sorted(per_range)
    carried, below = {}, {}
    for i, _ in enumerate(values):
        descending = list(reversed(order))
        sums = [per_range[p][f"t{i}"] for p in descending]
        for p, before in zip(descending, accumulate([0, *sums])):
            carried.setdefault(p, []).append(before)
    for position, p in enumerate(order):
        lower = per_range[order[position - 1]] if position else None
        below[p] = [lower[f"n{i}"] if lower else None for i, _ in enumerate(values)]

    def lookup(table: dict, i: int) -> Column:
        width = max(order) + 1
        entries = [table[p][i] if p in table else None for p in range(width)]
        text = ", ".join("NULL" if e is None else f"{e}L" for e in entries)
        return F.get(F.expr(f"CAST(array({text}) AS array<bigint>)"), F.col(part))

    inside = Window.partitionBy(part).orderBy(col(key).desc())
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = with_bin_number(groups, part, key, inner)
    added = {}
    for i, v in enumerate(values):
        added[f"cum_{v}"] = F.sum(col(v)).over(upto) + lookup(carried, i)
        added[f"next_{v}"] = F.coalesce(F.lead(col(v)).over(inside), lookup(below, i))
    return out.withColumns(added).drop(part)


def hash_cutoff(
    df: DataFrame, digest: Column, rank: Callable[[int], int]
) -> tuple[str, int, int, int]:
    """Where a row lies in the order of a hexadecimal digest; ``rank`` turns the number of
    rows into the place wanted (from 1).

    Returns that place, the digest there, the rows below that digest and the rows that
    carry it. Counts per digest prefix narrow the search; whole digests are read only from
    a prefix that few rows share, or that cannot be told apart further."""
    digests = df.select(digest.alias("h"))
    prefix, below, n, width = "", 0, None, 32
    step = 4
    while True:
        part = digests.where(F.col("h").startswith(prefix)) if prefix else digests
        counts = part.groupBy(F.substring("h", 1, step).alias("p")).agg(
            F.count(F.lit(1)).alias("n")
        )
        table = counts.toArrow().sort_by("p")
        upto = below + np.cumsum(table["n"].to_numpy())
        if n is None:
            n = rank(int(upto[-1]) if len(upto) else 0)
        at = int(np.searchsorted(upto, n))
        prefix, found = table["p"][at].as_py(), table["n"][at].as_py()
        below = int(upto[at]) - found
        if step == width:
            return n, prefix, below, found
        step = width if found <= COLLECT_LIMIT else step + 4


def _literal(value, data_type: T.DataType) -> Column:
    return F.lit(value).cast(data_type)


def order_cutoff(
    df: DataFrame, columns: Sequence[str], rank: Callable[[int], int]
) -> tuple[int, Column, int, int]:
    """The same for the order of some columns (ascending, nulls first).

    Pivots from a small sample split the rows, counts pick the piece with the n-th row,
    and the search goes on inside it. The sample steers, the counts decide. Returns the
    place, a literal struct to compare ``struct(columns)`` with, rows below it and rows
    equal to it."""
    types = [df.schema[c].dataType for c in columns]
    key = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(columns)])
    keys = df.select(key.alias("k"))

    def literal(row) -> Column:
        return F.struct(
            *[_literal(row[i], t).alias(f"k{i}") for i, t in enumerate(types)]
        )

    below, size = 0, keys.count()
    n = rank(size)
    while size > COLLECT_LIMIT:
        share = min(1.0, 2000 / size)
        sample = keys.sample(fraction=share, seed=random.randrange(2**31))
        pivots = sample.agg(F.sort_array(F.collect_set("k"))).first()[0]
        pivots = pivots[:: max(1, len(pivots) // 24)]
        if not pivots:
            continue
        literals = [literal(p) for p in pivots]

        def code(low: int, high: int) -> Column:
            if low == high:
                return F.lit(2 * low)
            mid = (low + high) // 2
            return (
                F.when(F.col("k") < literals[mid], code(low, mid))
                .when(F.col("k") == literals[mid], F.lit(2 * mid + 1))
                .otherwise(code(mid + 1, high))
            )

        counted = keys.groupBy(code(0, len(pivots)).alias("code")).agg(
            F.count(F.lit(1)).alias("n")
        )
        for row in sorted(counted.collect()):
            if below + row["n"] >= n:
                break
            below += row["n"]
        at, size = row["code"], row["n"]
        if at % 2:
            return n, literals[at // 2], below, size
        slot = at // 2
        if slot:
            keys = keys.where(F.col("k") > literals[slot - 1])
        if slot < len(pivots):
            keys = keys.where(F.col("k") < literals[slot])
    # At most COLLECT_LIMIT rows are left.
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for row in counts.agg(F.sort_array(F.collect_list(F.struct("k", "n")))).first()[0]:
        if below + row["n"] >= n:
            return n, literal(row["k"]), below, row["n"]
        below += row["n"]
    raise ValueError(f"fewer than {n} rows")
