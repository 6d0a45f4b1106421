"""Context-triggered piecewise hashes of texts.

A rolling hash of the last bytes decides where a chunk ends, so an edit moves only the
borders near it: chunks of block size 2^k end where k bits of the hash are zero. Every chunk gives one letter, the letters of a text's chunks
form its signature. A fingerprint holds the signatures of one block size and of its double.
Two fingerprints are alike by the edit distance of their signatures at a block size that both
have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurekit.llm.tables import id_and_text
from featurekit.llm.words import _power_tables, mix, slices

#: Bytes that decide whether a chunk ends here.
WINDOW = 7
#: The largest block size (a power of two) that fits so often into the text is taken, as texts of
#: about the same length must be comparable; what follows the last letter but one of LETTERS
#: letters is one chunk, which only texts made of repetitions reach.
CHUNKS, LETTERS = 64, 256
#: Signatures are alike only if they share a run of so many letters, or half the shorter one.
COMMON = 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLOCK = 1 << 18
#: Low bits of the rolling hash that decide nothing, as the higher ones are better mixed.
_SPARE = np.uint64(20)
#: Ranges of ids per shuffle partition.
RANGES = 4


def chunk_ends(data: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places after which a chunk of block size 2^level ends, the last byte's included; whether
    one of twice the size does; the sum of all bytes' numbers, each times a power of its
    place, up to there; and the inverse of that power there."""
    powers, inverses = _power_tables(_BLOCK + WINDOW)
    ends, double, sums, backs = [], [], [], []
    total, scale, back = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(data), _BLOCK):
        low = max(0, at - WINDOW)
        numbers = _BYTE[data[low : at + _BLOCK]]
        sum_to = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(numbers * powers[: len(numbers)], out=sum_to[1:])
        rolled = sum_to[1:].copy()
        if len(rolled) > WINDOW:
            rolled[WINDOW:] -= sum_to[1:-WINDOW]
            rolled[WINDOW:] *= inverses[1 : len(rolled) - WINDOW + 1]
        rolled = rolled[at - low :] >> _SPARE
        here = np.flatnonzero((rolled & np.uint64((1 << level) - 1)) == 0)
        if at + _BLOCK >= len(data) and (not len(here) or here[-1] < len(rolled) - 1):
            here = np.append(here, len(rolled) - 1)
        begin, local = sum_to[at - low], here + 1 + at - low
        # From powers counted from ``low`` to powers counted from the text's start.
        shift = inverses[at - low] * scale
        ends.append(at + here + 1)
        double.append((rolled[here] & np.uint64((2 << level) - 1)) == 0)
        sums.append(total + (sum_to[local] - begin) * shift)
        backs.append(back * inverses[here + 1])
        total = total + (sum_to[-1:] - begin) * shift
        scale, back = scale * powers[_BLOCK], back * inverses[_BLOCK]
    return tuple(np.concatenate(x) for x in (ends, double, sums, backs))


def fingerprint(text: str | None) -> str:
    """Block size, signature at it, and signature at its double, parted by colons. The text's
    UTF-8 bytes count; null is empty, and an empty text has empty signatures at block size 1."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return "1::"
    level = max(0, (len(data) // CHUNKS).bit_length() - 1)
    ends, double, sums, backs = chunk_ends(data, level)
    double[-1] = True
    larger = np.flatnonzero(double)
    return f"{1 << level}:{_signature(ends, sums, backs)}:{_signature(ends[larger], sums[larger], backs[larger])}"


def _signature(ends: np.ndarray, sums: np.ndarray, backs: np.ndarray) -> str:
    """A letter per chunk from the hash of its bytes, which is the same wherever it stands."""
    if len(ends) > LETTERS:
        keep = np.append(np.arange(LETTERS - 1), len(ends) - 1)
        ends, sums, backs = ends[keep], sums[keep], backs[keep]
    hashed, length = sums.copy(), ends.copy()
    hashed[1:] = (sums[1:] - sums[:-1]) * backs[:-1]
    length[1:] -= ends[:-1]
    return ALPHABET[mix(hashed + length.astype(np.uint64)) >> np.uint64(58)].tobytes().decode()


def _shared(a: str, b: str) -> int:
    """Letters of a longest common subsequence: one bit per letter of a, all at once."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for letter in b:
        met = row & places.get(letter, 0)
        row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def _likeness_of_signatures(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    run = min(COMMON, (min(len(a), len(b)) + 1) // 2)
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    # The edit distance by insertions and deletions is len(a) + len(b) - 2 * shared.
    return 2 * _shared(a, b) / (len(a) + len(b))


def likeness_of(a: str | None, b: str | None) -> float | None:
    """1 for equal fingerprints; else 1 minus the edit distance (insertions and deletions) over
    both lengths, the greater one if two block sizes agree; 0 if none does, or if the
    signatures share no run of letters. Null if one is null."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    signatures = []
    for whole in (a, b):
        size, one, two = whole.split(":")
        signatures.append({int(size): one, 2 * int(size): two})
    sizes = signatures[0].keys() & signatures[1].keys()
    return max((_likeness_of_signatures(signatures[0][s], signatures[1][s]) for s in sizes), default=0.0)


def fingerprints(texts: Column) -> Column:
    """The fingerprint of each text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="object")

    return run(texts)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints, 0 to 1."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(a, b)


def with_next(table: DataFrame, order: str, values: dict[str, str], numbers: DataFrame | None = None) -> DataFrame:
    """The table with values of the row that follows each row by a whole-number column; the
    last row is followed by the first, a single one by itself.

    values: new column -> column to read from the next row. numbers: a table with the same
    numbers that is cheaper to read for the bounds. Null numbers come first; rows with
    the same number stand by the values read. The numbers are cut into ranges whose bounds come
    from a sketch of them; the first row of each range is also sent to the range before it, so
    every row finds its follower inside its range. Rows with the same number share a range.
    """
    spark = table.sparkSession
    wanted = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col(f"`{order}`").cast("long")
    place = F.coalesce(number.cast("double"), F.lit(float("-inf")))
    # At most ``wanted`` bounds, and as many first numbers, come to the driver.
    shares = [i / wanted for i in range(1, wanted)]
    numbers = table if numbers is None else numbers
    bounds = numbers.agg(F.percentile_approx(place, shares, max(10_000, 10 * wanted))).first()[0]
    inner = sorted({b for b in bounds or () if b > float("-inf")})
    packed = table.select(number.alias("number"), place.alias("place"), F.struct("*").alias("row"))
    splits = [float("-inf"), *inner, float("inf")]

    def ranged(df: DataFrame) -> DataFrame:
        if not inner:
            return df.withColumn("range", F.lit(0.0))
        return Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(df)

    lowest = F.min(F.struct(F.col("number").isNotNull().alias("known"), "number"))
    lows = ranged(numbers.select(number.alias("number"), place.alias("place"))).groupBy("range").agg(lowest.alias("low")).collect()
    first = sorted((r["range"], r["low"]["number"]) for r in lows)
    known = F.broadcast(
        spark.createDataFrame([(r, n, first[i - 1][0]) for i, (r, n) in enumerate(first)], "range double, first long, before double")
    )
    here = F.struct("range", F.lit(False).alias("copy"))
    there = F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))
    sent = ranged(packed).join(known, "range").select(
        "number", "row", F.explode(F.when(F.col("number").eqNullSafe(F.col("first")), F.array(here, there)).otherwise(F.array(here))).alias("to")
    )
    read = [F.col("row")[c] for c in values.values()]
    by = [F.col("to.copy"), F.col("number").asc_nulls_first(), *[c.asc_nulls_first() for c in read]]
    follower = F.lead(F.struct(*[c.alias(n) for c, n in zip(read, values, strict=True)]))
    return (
        sent.withColumn("next", follower.over(Window.partitionBy("to.range").orderBy(*by)))
        .where(~F.col("to.copy"))
        .select("row.*", *[F.col("next")[n].alias(n) for n in values])
    )


def compare_edited(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts, one row per row of docs: doc_id, n_chars,
    edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter (rounded down, in characters) replaced by as many first
    characters of the next document by id, or by all of it if it is shorter. near_next compares
    with the next document. Null texts are empty, and so is their edited text; equal texts have
    equal fingerprints and a likeness of 1. Repeated ids follow one another in a fixed order of
    their texts, null ids come first; an empty table gives an empty one; other columns are not
    read. A text of any length is held by one task, with some ten bytes a byte. Texts move once,
    each compressed by itself, as the rows of a shuffle block have too little in common.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            data = [t.encode() for t in texts]
            packed = [codec.compress(t, asbytes=True) for t in data]
            columns = [pa.array([len(t) for t in data], pa.int64()), pa.array(packed, pa.binary()), pa.array(map(fingerprint, texts), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "size", "packed", "fingerprint"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(batches, "packed"):
            rows = []
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names[1:]), strict=True):
                size, packed, own, next_size, next_packed, following = row
                text, after = (codec.decompress(p, n, asbytes=True).decode() for p, n in ((packed, size), (next_packed, next_size)))
                new = len(text) // 4
                edited = text[: len(text) - new] + after[:new]
                changed = fingerprint(edited)
                rows.append((len(text), edited, own, changed, likeness_of(own, changed), likeness_of(own, following)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    own = id_and_text(docs, doc_id, text).mapInArrow(pack, "doc_id long, size long, packed binary, fingerprint string")
    following = {"next_size": "size", "next_packed": "packed", "next_fingerprint": "fingerprint"}
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(own, "doc_id", following, id_and_text(docs, doc_id, text)).mapInArrow(compare, schema)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses with a digest of the edited text in place of the text."""
    return compare_edited(docs).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
