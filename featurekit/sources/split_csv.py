"""Large CSV files whose cells may hold line breaks, read by many tasks.

Spark's text reader splits a file at line ends and tells where each split starts. A first pass
counts the quotes of every split; the parity of all quotes before a split says whether it starts
inside a quoted cell. The second pass puts lines together to records within each split, in
one task per group of splits and without a shuffle. Only records that cross a split are
put together from their pieces afterwards: two pieces per split at most, more only where a
record is longer than a split.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import quoted

# Files up to this size are left to one task each.
SPLIT_BYTES = 32 << 20

_PIECES = "file long, split long, place int, opens boolean, closes boolean, first boolean, record string"


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): lines in order within a split; a carriage return stays."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            "value",
        )
    )


def split_states(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, split, inside, odd, line): whether each split starts inside a quoted cell, lines with
    a quote in the middle of an unquoted cell, and the first line. A row per split."""
    other = f'[^{_in_class(delimiter)}"\\r]'
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "split").agg(
        F.sum(quotes).alias("quotes"),
        F.count_if(F.col("value").rlike(f'{other}"{other}')).alias("odd"),
        F.first("value").alias("line"),  # one task reads a split, in order
    )
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    return counted.select("file", "split", inside.alias("inside"), "odd", F.when(F.col("split") == 0, F.col("line")).alias("line"))


def _in_class(delimiter: str) -> str:
    return "\\" + delimiter if not delimiter.isalnum() and not delimiter.isspace() else delimiter


def pieces_of(batches: Iterator[pa.RecordBatch], well_formed: str) -> Iterator[pa.RecordBatch]:
    """Records, or pieces of records at the borders of a split, from lines with their split's state.
    Places count the pieces of a split; ``first`` marks a file's first record."""
    at, held, place, inside = None, [], 0, False

    def close() -> Iterator[pa.RecordBatch]:
        """What the split before has left open."""
        if held:
            yield _records([at], [place], [place > 0 or not started], [False], [at[1] == 0 and place == 0], ["\n".join(held)])

    started = False  # inside a cell from the start of the split on
    for batch in batches:
        if not batch.num_rows:
            continue
        file, split = batch.column("file").to_numpy(), batch.column("split").to_numpy()
        starts = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (split[1:] != split[:-1])))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            key = (int(file[a]), int(split[a]))
            if key != at:
                yield from close()
                at, held, place = key, [], 0
                inside = started = bool(batch.column("inside")[a].as_py())
            lines = batch.column("value").slice(a, b - a)
            open_after = (np.cumsum(pc.count_substring(lines, '"').to_numpy()) + inside) % 2 == 1
            ends = np.flatnonzero(~open_after) + 1  # a record ends after these lines
            if not len(ends):
                held += lines.to_pylist()
                inside = bool(open_after[-1])
                continue
            offsets = np.append(0, ends)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines.slice(0, ends[-1])), "\n")
            if held:
                text = pa.concat_arrays([pa.array(["\n".join([*held, text[0].as_py()])]), text.slice(1)])
            n = len(text)
            opens = np.ones(n, bool)
            opens[0] = place > 0 or not started
            first = np.zeros(n, bool)
            first[0] = place == 0 and at[1] == 0
            complete = text.filter(pa.array(opens))
            quoted = complete.filter(pc.match_substring(complete, '"'))
            if not pc.all(pc.match_substring_regex(quoted, well_formed), min_count=0).as_py():
                raise ValueError("a quote stands inside an unquoted cell; read the file with split=False")
            yield _records([at] * n, np.arange(place, place + n), opens, np.ones(n, bool), first, text)
            place += n
            held = lines.slice(ends[-1]).to_pylist()
            inside = bool(open_after[-1])
    yield from close()


def _records(at, place, opens, closes, first, text) -> pa.RecordBatch:
    file, split = zip(*at, strict=True)
    arrays = [pa.array(file, pa.int64()), pa.array(split, pa.int64()), pa.array(place, pa.int32())]
    arrays += [pa.array(x, pa.bool_()) for x in (opens, closes, first)]
    arrays.append(text if isinstance(text, pa.Array) else pa.array(text, pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _PIECES.split(", ")])


def read_split_csv(spark: SparkSession, path: str, header: Sequence[str], delimiter: str) -> DataFrame | None:
    """The table with all columns as text, in many tasks; None if quotes stand inside unquoted
    cells, which only a reader that starts at the file's beginning understands, or if files
    differ in their line ends. Where lines end with a carriage return, those inside cells
    become plain line breaks too, as in Spark's reader."""
    lines = lines_of(spark, path)
    states = split_states(lines, delimiter).collect()  # a row per split
    if any(r["odd"] for r in states):
        return None
    for r in states:
        if r["line"] is not None and next(csv.reader([r["line"].rstrip("\r")], delimiter=delimiter), []) != list(header):
            raise ValueError(f"a file's header is not {list(header)}")
    ends = {r["line"].endswith("\r") for r in states if r["line"] is not None}
    if len(ends) > 1:
        return None
    known = spark.createDataFrame([(r["file"], r["split"], r["inside"]) for r in states], "file long, split long, inside boolean")
    sep = _in_class(delimiter)
    cell = f'(?:"(?:[^"]|"")*"|[^"{sep}]*)'
    well_formed = f"(?s)^{cell}(?:{sep}{cell})*\\r?$"
    # The states are bounded by the number of splits; lines keep their order in a broadcast join.
    marked = lines.join(F.broadcast(known), ["file", "split"]).select("file", "split", "inside", "value")
    pieces = marked.mapInArrow(lambda batches: pieces_of(batches, well_formed), _PIECES)
    whole = pieces.where("opens AND closes AND NOT first").select("record")
    # Pieces of records that cross a split: a record starts at a piece that opens one.
    parts = pieces.where("NOT (opens AND closes)")
    order = Window.partitionBy("file").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("number", F.sum(F.col("opens").cast("long")).over(order))
    listed = F.sort_array(F.collect_list(F.struct("split", "place", "record")))
    joined = numbered.groupBy("file", "number").agg(
        F.array_join(F.transform(listed, lambda p: p["record"]), "\n").alias("record"), F.max("first").alias("first")
    )
    records = whole.unionAll(joined.where(~F.col("first")).select("record"))
    record = F.regexp_replace("record", "\r$", "")
    if ends == {True}:
        record = F.replace(record, F.lit("\r\n"), F.lit("\n"))
    names = ", ".join(f"{quoted(name)} STRING" for name in header)
    parsed = F.from_csv(record, names, {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"})
    return records.where(record != "").select(parsed.alias("cells")).select("cells.*")
