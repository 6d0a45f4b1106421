"""Column selections: dropping features, choosing numeric or training columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import column_list
from ..schema import (
    FEATURE,
    col,
    columns_with_role,
    is_missing,
    is_numeric,
    require_columns,
)

# Columns whose missing cells one sum counts.
FLAGS_PER_SUM = 32


def feature_filter(df: DataFrame, drop_features: str | Sequence[str]) -> DataFrame:
    """The table without some columns, of any role; order and roles of the rest stay and
    unknown names are ignored."""
    dropped = set(column_list("drop_features", drop_features, low=1))
    return df.select([col(c) for c in df.columns if c not in dropped])


def selected_features(df: DataFrame, feature_selects: Sequence[str] | None = ()) -> list[str]:
    """The named columns in table order; none named means every feature."""
    names = column_list("feature_selects", feature_selects)
    require_columns(df, names)
    wanted = set(names or columns_with_role(df, FEATURE))
    return [c for c in df.columns if c in wanted]


def numeric_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of the columns that are numbers (bool and text are not)."""
    return [c for c in names if is_numeric(df.schema[c].dataType)]


def training_features(df: DataFrame, ids: Sequence[str], label: str) -> list[str]:
    """Features to train on: all features but the given ids and the label."""
    taken = {*ids, label}
    return [c for c in columns_with_role(df, FEATURE) if c not in taken]


def label_number(df: DataFrame, label: str) -> Column:
    """The label as double, null where it is no number; bool counts as 0/1."""
    x = col(label)
    if df.schema[label].dataType.typeName() == "string":
        x = x.try_cast("double")
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def missing_count(df: DataFrame, names: Sequence[str]) -> Column:
    """Aggregate: missing cells in the named columns. Sums over some columns each stay in
    compiled code, whatever their number."""
    if not names:
        return F.lit(0).cast("long")
    flags = [is_missing(df, name).cast("int") for name in names]
    chunks = [flags[i : i + FLAGS_PER_SUM] for i in range(0, len(flags), FLAGS_PER_SUM)]
    return F.coalesce(_added([F.sum(_added(chunk)) for chunk in chunks]), F.lit(0).cast("long"))


def _added(terms: Sequence[Column]) -> Column:
    """The sum of some columns as a balanced tree."""
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return _added(terms[:half]) + _added(terms[half:])


def reject_missing(count: int, operator: str) -> None:
    if count:
        raise ValueError(f"{operator} does not support missing values: {count} found")
