"""Inner join of two to ten tables on keys that may be named differently per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import column_list
from ..schema import col, is_numeric, require_columns

MAX_INPUTS = 10


def _check_types(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> None:
    for a, b in pairs:
        ta, tb = left.schema[a].dataType, right.schema[b].dataType
        if ta != tb and not (is_numeric(ta) and is_numeric(tb)):
            raise ValueError(
                f"join keys {a} ({ta.simpleString()}) and {b} ({tb.simpleString()}) "
                "have different types"
            )


def _join_pair(
    left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_keys: str
) -> DataFrame:
    shared = {a for a, b in pairs if a == b}
    clash = sorted((set(left.columns) & set(right.columns)) - shared)
    if clash:
        raise ValueError(f"columns occur in two inputs and are not a common key: {clash}")
    if left.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        spelled = {c.lower(): c for c in left.columns}
        clash = [c for c in right.columns if c not in shared and c.lower() in spelled]
        if clash:
            raise ValueError(
                f"columns differ in case only: {clash}; set spark.sql.caseSensitive=true"
            )
    kept = left.columns + [c for c in right.columns if c not in shared]
    # Renamed keys keep both sides apart without aliases, whatever their lineage.
    for b in dict.fromkeys(b for _, b in pairs):
        right = right.withColumn(f"__key_{b}", col(b))
    right = right.drop(*shared)
    condition = F.lit(True)
    for a, b in pairs:
        x, y = col(a), col(f"__key_{b}")
        condition = condition & (x.eqNullSafe(y) if null_keys == "match" else x == y)
    return left.join(right, condition, "inner").select([col(c) for c in kept])


def psi(
    *inputs: DataFrame,
    keys: Sequence[Sequence[str]] | Sequence[str],
    null_keys: str = "match",
) -> DataFrame:
    """Join every table to the first one's key.

    ``keys`` is one list of column names per input (or one list for all of them). A key
    column with the same name on both sides appears once, others stay. Null keys match
    each other unless ``null_keys="drop"``: then every null of one side meets every null of
    the other, which is many rows if both have many.

    The call runs nothing. A key that holds much of the rows is split by Spark while the
    join runs (``spark.sql.adaptive.skewJoin.enabled``, on by default): it deals the map
    blocks of such a partition to several tasks, so identical rows are split as well.
    """
    if not 2 <= len(inputs) <= MAX_INPUTS:
        raise ValueError(f"psi takes 2 to {MAX_INPUTS} inputs, got {len(inputs)}")
    if null_keys not in ("match", "drop"):
        raise ValueError(f"null_keys must be match or drop, got {null_keys!r}")
    if all(isinstance(k, str) for k in keys):
        keys = [list(keys)] * len(inputs)
    if len(keys) != len(inputs):
        raise ValueError(f"{len(inputs)} inputs but {len(keys)} key lists")
    lists = [column_list("key", k, low=1) for k in keys]
    for df, names in zip(inputs, lists):
        if len(names) != len(lists[0]):
            raise ValueError("join keys must have the same number of columns")
        require_columns(df, names)
    out = inputs[0]
    for df, names in zip(inputs[1:], lists[1:]):
        pairs = list(zip(lists[0], names))
        _check_types(out, df, pairs)
        out = _join_pair(out, df, pairs, null_keys)
    return out


inner_join = psi
