"""Tables as CSV or Parquet, with roles and types declared by the caller."""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import col, declared_roles, spark_type, table_schema
from . import split_csv
from .split_csv import largest_file, read_split_csv

# Cells that count as missing in a CSV file: fixed values, those of pandas' reader.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def csv_layout(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Delimiter and column names, told from the first two lines; comma in doubt."""
    lines = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    if not lines:
        raise ValueError(f"{path} is empty")
    try:
        delimiter = csv.Sniffer().sniff("\n".join(lines) + "\n").delimiter
    except csv.Error:
        delimiter = ","
    if delimiter.isalnum():
        delimiter = ","
    return delimiter, next(csv.reader(lines[:1], delimiter=delimiter))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: Mapping[str, Sequence[str]],
    columns: Sequence[str] | None = None,
    line_breaks: bool = True,
    split: bool = True,
) -> DataFrame:
    """A CSV table with a header. ``schema`` holds ids/features/labels and their
    *_types lists; every column of the file must be declared. ``columns`` limits the
    scan, in file order. Quotes inside a quoted cell are doubled.

    Cells may hold line breaks; large files are still read by many tasks, after a pass that
    counts quotes. ``split=False`` leaves each file to one task, as are files with quotes in
    the middle of unquoted cells. ``line_breaks=False`` is for files known to have none
    inside cells: they are split without that pass."""
    delimiter, header = csv_layout(spark, path)
    roles = declared_roles(schema)
    unknown = [c for c in header if c not in roles]
    if unknown:
        raise ValueError(f"columns not found in the schema: {unknown}")
    raw = None
    if line_breaks and split and largest_file(spark, path) > split_csv.SPLIT_BYTES:
        raw = read_split_csv(spark, path, header, delimiter)
    raw = raw if raw is not None else (
        spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
        .option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", line_breaks)
        .option("enforceSchema", False)
        .csv(path)
    )
    out = []
    for name in header:
        if columns is not None and name not in columns:
            continue
        role, declared = roles[name]
        cell = F.when(~col(name).isin(*NA_TOKENS), col(name)).cast(spark_type(declared))
        out.append(cell.alias(name, metadata={"role": role}))
    return raw.select(out)


def read_parquet(
    spark: SparkSession,
    path: str,
    schema: Mapping[str, Sequence[str]] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A Parquet table; its roles are in the file unless a schema is given."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select([col(c) for c in df.columns if c in columns])
    if schema is None:
        return df
    roles = declared_roles(schema)
    unknown = [c for c in df.columns if c not in roles]
    if unknown:
        raise ValueError(f"columns not found in the schema: {unknown}")
    return df.select(
        [
            col(c).cast(spark_type(roles[c][1])).alias(c, metadata={"role": roles[c][0]})
            for c in df.columns
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes inside a cell are doubled, white space stays."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    for side in ("Leading", "Trailing"):
        writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small document, on whatever file system the path names."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def write_schema(df: DataFrame, path: str, lineage: Sequence[str] = ()) -> None:
    """The schema side-car: role lists, types, and the tables this one came from."""
    document = {**table_schema(df), "lineage": list(lineage)}
    write_text(df.sparkSession, json.dumps(document), path)


def read_schema(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))
