"""Small helpers for tables between the steps of an operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.session import remove_folder, shared_folder


#: Folders written while a list is recorded, innermost last.
_records: list[list[str]] = []


def written(df: DataFrame) -> DataFrame:
    """The table after a write to the shared folder: lineage is cut, and lost executors
    only read files again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    for record in _records:
        record.append(path)
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` has made and nothing reads any more."""
    for table in tables:
        remove_folder(table.sparkSession, table._folder)


@contextmanager
def recorded(folders: list[str]) -> Iterator[None]:
    """Note the folders of all tables written meanwhile."""
    _records.append(folders)
    try:
        yield
    finally:
        _records.remove(folders)


def release_folders(spark: SparkSession, folders: list[str], kept: DataFrame) -> None:
    """Delete noted folders, but not those that a table still reads; the others leave the list."""
    read = kept.inputFiles()
    for path in list(folders):
        name = path.rsplit("/", 1)[-1]
        if not any(name in file for file in read):
            remove_folder(spark, path)
            folders.remove(path)


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that names of others cannot clash."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
