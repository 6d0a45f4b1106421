"""Column roles and the declared-type map.

A table has three kinds of columns: ids, features and labels. The role lives in
``StructField.metadata["role"]``, so it survives every plan that keeps the column and is
stored by Parquet without a side-car. A column without a role is a feature.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, FEATURE, LABEL = "id", "feature", "label"
ROLES = (ID, FEATURE, LABEL)

# Declared type names, fixed values: every integer width widens to long, every float
# width to double, anything unknown is text.
INT_TYPES = frozenset(
    ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "int"]
)
FLOAT_TYPES = frozenset(["float16", "float32", "float64", "float"])
BOOL_TYPE = "bool"


def spark_type(declared: str) -> T.DataType:
    """Spark type of a declared column type."""
    if declared in INT_TYPES:
        return T.LongType()
    if declared in FLOAT_TYPES:
        return T.DoubleType()
    if declared == BOOL_TYPE:
        return T.BooleanType()
    return T.StringType()


def type_name(data_type: T.DataType) -> str:
    """Name reported for a Spark type: int64, float64, bool or str."""
    if isinstance(data_type, T.IntegralType):
        return "int64"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "float64"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    return "str"


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def role_of(field: T.StructField) -> str:
    role = (field.metadata or {}).get("role", FEATURE)
    return role if role in ROLES else FEATURE


def with_roles(
    df: DataFrame,
    ids: Iterable[str] = (),
    labels: Iterable[str] = (),
    features: Iterable[str] | None = None,
) -> DataFrame:
    """Mark columns; columns not named keep the role they have."""
    wanted = {name: FEATURE for name in (features or ())}
    wanted |= {name: LABEL for name in labels}
    wanted |= {name: ID for name in ids}
    require_columns(df, wanted)
    columns = [
        col(f.name).alias(f.name, metadata={**f.metadata, "role": wanted[f.name]})
        if f.name in wanted
        else col(f.name)
        for f in df.schema.fields
    ]
    return df.select(columns)


def columns_with_role(df: DataFrame, role: str) -> list[str]:
    return [f.name for f in df.schema.fields if role_of(f) == role]


def table_schema(df: DataFrame) -> dict[str, list[str]]:
    """The role lists with their parallel type lists, ready for a JSON side-car."""
    out: dict[str, list[str]] = {}
    for role in ROLES:
        fields = [f for f in df.schema.fields if role_of(f) == role]
        out[f"{role}s"] = [f.name for f in fields]
        out[f"{role}_types"] = [type_name(f.dataType) for f in fields]
    return out


def declared_roles(schema: Mapping[str, Sequence[str]]) -> dict[str, tuple[str, str]]:
    """column -> (role, declared type); ids win over features, features over labels."""
    out: dict[str, tuple[str, str]] = {}
    for role in ROLES:
        names = list(schema.get(f"{role}s", ()))
        types = list(schema.get(f"{role}_types", ()))
        if len(names) != len(types):
            raise ValueError(f"{role}s and {role}_types differ in length")
        for name, declared in zip(names, types):
            out.setdefault(name, (role, declared))
    return out


def quoted(name: str) -> str:
    """Back-quoted column name for SQL text; names may hold blanks and dots."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null, so that "missing" is one thing."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double")).alias(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()
