"""Bin edges (equal width, equal frequency), their labels, and bin numbers of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import quoted

# Above this many edges a comparison tree would outgrow the JIT's method size.
_TREE_EDGES = 96


def double_sql(value: float) -> str:
    """A double as SQL text that parses back to the same bits."""
    value = float(value)
    if math.isinf(value) or math.isnan(value):
        name = "NaN" if math.isnan(value) else ("Infinity" if value > 0 else "-Infinity")
        return f"CAST('{name}' AS DOUBLE)"
    return f"{value!r}D"


def double_array(values: Sequence[float]) -> Column:
    """Literal array, parsed in one go instead of built element by element."""
    return F.expr(f"array({', '.join(map(double_sql, values))})")


def bin_number_sql(name: str, edges: Sequence[float], right_closed: bool = True) -> str:
    """SQL text for the number of edges below the value (``< x``, or ``<= x`` when the
    bins are left-closed); a balanced comparison tree, so log2(edges) steps per row."""
    x, op = quoted(name), "<=" if right_closed else "<"

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return (
            f"IF({x} {op} {double_sql(edges[mid])}, {tree(low, mid)}, {tree(mid + 1, high)})"
        )

    return f"IF({x} IS NULL, NULL, {tree(0, len(edges))})"


def with_bin_number(
    df: DataFrame, out: str, name: str, edges: Sequence[float], right_closed: bool = True
) -> DataFrame:
    """Add the bin number of a double column; null stays null."""
    edges = [float(e) + 0.0 for e in edges]
    if len(edges) <= _TREE_EDGES or not all(map(math.isfinite, edges)):
        return df.withColumn(out, F.expr(bin_number_sql(name, edges, right_closed)))
    distinct, copies = np.unique(edges, return_counts=True)
    if len(distinct) < len(edges):
        # A bin of no width is counted, but no value falls into it.
        df = with_bin_number(df, out, name, distinct.tolist(), right_closed)
        passed = F.array(*[F.lit(int(n)) for n in np.r_[0, np.cumsum(copies)]])
        return df.withColumn(out, F.get(passed, F.col(quoted(out))))
    # Bucketizer does a binary search on left-closed buckets; the mirrored axis turns
    # them into right-closed ones.
    splits = [-e for e in reversed(edges)] if right_closed else edges
    source = f"__{out}_x"
    value = F.col(quoted(name)) + F.lit(0.0)
    df = df.withColumn(source, F.lit(0.0) - value if right_closed else value)
    df = Bucketizer(
        splits=[-math.inf, *splits, math.inf],
        inputCol=source,
        outputCol=f"__{out}_b",
        handleInvalid="keep",
    ).transform(df)
    number = F.col(f"__{out}_b").cast("int")
    if right_closed:
        number = F.lit(len(edges)) - number
    return df.withColumn(out, F.when(F.col(source).isNotNull(), number)).drop(
        source, f"__{out}_b"
    )


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """bins+1 evenly spaced edges; the first one is lowered by 0.1% of the range so that
    the minimum falls inside. A constant column gets a small band around its value."""
    if low == high:
        low -= 0.001 * abs(low) if low != 0 else 0.001
        high += 0.001 * abs(high) if high != 0 else 0.001
        return [float(e) for e in np.linspace(low, high, bins + 1)]
    edges = np.linspace(low, high, bins + 1)
    edges[0] -= 0.001 * (high - low)
    return [float(e) for e in edges]


def distinct_edges(quantiles: Sequence[float]) -> list[float]:
    """Equal-frequency edges: quantiles in order without repeats."""
    return sorted(set(quantiles))


def equal_frequency_probs(bins: int) -> list[float]:
    return [float(p) for p in np.linspace(0, 1, bins + 1)]


def rounded_edges(
    edges: Sequence[float], precision: int = 3, lower_first: bool = True
) -> list[float]:
    """Edges as a bin label shows them, rising ones. They have ``precision`` decimals, those
    between -1 and 1 as many significant digits; as many more as keep neighbours apart, 19
    at most. ``lower_first`` moves the first one down by one unit of the last digit so that
    the minimum stays inside."""
    exact = np.asarray(edges, dtype=float)
    # Decimals that only lead to the first significant digit.
    with np.errstate(divide="ignore"):
        order = np.floor(np.log10(np.abs(exact)))
    leading = np.where(np.isfinite(order) & (order < 0), -1 - order, 0).astype(int)

    def shown(digits: int) -> np.ndarray:
        return np.array([np.round(x, digits + k) for x, k in zip(exact, leading)])

    clear = (d for d in range(precision, 20) if (np.diff(shown(d)) > 0).all())
    digits = next(clear, precision)
    labels = shown(digits)
    if lower_first and len(labels):
        labels[0] -= 10.0**-digits
    return labels.tolist()
