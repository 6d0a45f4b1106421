"""Exact train/test split without a global sort and without a shuffle of the rows."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import hash_cutoff, order_cutoff
from ..params import column_list, resolve
from ..schema import ID, col, columns_with_role, require_columns


def _digest(seed: int, key: Sequence[str]) -> Column:
    parts = [F.coalesce(col(k).cast("string"), F.lit("null")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _content(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*[col(c) for c in df.columns])))


def _repeat(row_of: DataFrame, copies: int) -> DataFrame:
    """One row, ``copies`` times, made by as many tasks as the count asks for."""
    at = "__one"
    one = row_of.limit(1).withColumn(at, F.lit(0))
    numbers = row_of.sparkSession.range(copies).select(F.lit(0).alias(at))
    return numbers.join(F.broadcast(one), at).select([col(c) for c in row_of.columns])


def _divide(df: DataFrame, n: int, order: Column, cut: Column, below: int, equal: int):
    """Rows before the cut against rows after it; rows equal to it fill up the first part,
    in the order of their content. Copies of one row are interchangeable, so those split
    by number."""
    missing = n - below
    if missing == equal:
        return df.where(order <= cut), df.where(order > cut)
    content = _content(df)
    _, digest, before, copies = hash_cutoff(df.where(order == cut), content, lambda _: missing)
    taken = missing - before
    tied = order == cut
    if taken == copies:
        first = df.where((order < cut) | (tied & (content <= digest)))
        return first, df.where((order > cut) | (tied & (content > digest)))
    same = df.where(tied & (content == digest))
    first = df.where((order < cut) | (tied & (content < digest)))
    second = df.where((order > cut) | (tied & (content > digest)))
    return first.unionAll(_repeat(same, taken)), second.unionAll(_repeat(same, copies - taken))


def train_test_split(
    df: DataFrame,
    key: Sequence[str] | str | None = None,
    order_by: Sequence[str] | str | None = None,
    exact: bool = True,
    **attributes,
) -> tuple[DataFrame, DataFrame]:
    """Split into floor(rows * train_size) training rows and the rest.

    Shuffled: rows are ordered by a hash of the seed and ``key`` (the id columns, else all
    columns), so the same seed gives the same split on any cluster. Unshuffled: the first
    rows in the order of ``order_by``; without it, in the order of the Parquet files (by path)
    and of the rows in each. Both outputs are plain filters on the input.
    Attributes: train_size, fix_random, random_state, shuffle. ``exact=False`` splits by
    hash value alone: no counting, sizes near the wanted share only.
    """
    state = attributes.pop("random_state", 1024)
    p = resolve("train_test_split", attributes | ({"random_state": state} if state else {}))
    seed = p["random_state"] if state and p["fix_random"] else random.randrange(1, 2**31)
    share = p["train_size"]
    if not p["shuffle"]:
        columns = column_list("order_by", order_by)
        if not columns:
            return _split_by_place(df, share)
        require_columns(df, columns)
        n, cut, below, equal = order_cutoff(df, columns, lambda rows: _train_rows(rows, share))
        order = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(columns)])
        return _divide(df, n, order, cut, below, equal)
    key = column_list("key", key) or columns_with_role(df, ID) or df.columns
    require_columns(df, key)
    digest = _digest(seed, key)
    if not exact:
        cut = F.lit(format(int(share * 16**12), "012x"))
        return df.where(F.substring(digest, 1, 12) < cut), df.where(
            F.substring(digest, 1, 12) >= cut
        )
    n, cut, below, equal = hash_cutoff(df, digest, lambda rows: _train_rows(rows, share))
    return _divide(df, n, digest, F.lit(cut), below, equal)


def _split_by_place(df: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The first rows of the files a table is read from: every row's file and place in it order
    the rows, a search over counts finds the cut, and nothing is sorted or numbered."""
    names = []
    for i in range(2):
        names.append(next(n for n in (f"__place{i}" + "_" * k for k in range(len(df.columns) + 1)) if n not in df.columns))
    try:
        placed = df.select(
            *[col(c) for c in df.columns],
            F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]),
        )
    except AnalysisException:
        raise ValueError("rows have an order only in Parquet files just read; give order_by") from None
    _, cut, _, _ = order_cutoff(placed, names, lambda rows: _train_rows(rows, share))
    order = F.struct(*[col(n).alias(f"k{i}") for i, n in enumerate(names)])
    return placed.where(order <= cut).drop(*names), placed.where(order > cut).drop(*names)


def _train_rows(rows: int, share: float) -> int:
    n = int(rows * share)
    if n < 1:
        raise ValueError(f"the training part needs at least 1 row, got {n}")
    return n
