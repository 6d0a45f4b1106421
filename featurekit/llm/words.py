"""Words and their hashes for whole Arrow batches of texts, in numpy.

A text is never turned into Python words: its bytes are classified by a table, word
borders are found for the whole batch at once, and each word gets a 64-bit hash of its
lower-cased (A-Z) bytes. Memory is bounded by the slice (``SLICE_BYTES``, or one text if
that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One random-looking number for each byte after lower-casing.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
#: White space: the space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 borders of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, first = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(column.buffers()[1], np.int64)[first : first + n + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[borders[0] : borders[-1]], borders - borders[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``SLICE_BYTES`` of text, at least one row each."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def borders_of_words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words; a word never spans two texts."""
    inner = ~SPACE[data]
    if not inner.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(len(data) + 1, bool)  # a text begins here
    fresh[borders] = True
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = ~inner[:-1]
    starts = np.flatnonzero(inner & (edge | fresh[:-1]))
    edge[:-1] = ~inner[1:]
    edge[-1] = True
    ends = np.flatnonzero(inner & (edge | fresh[1:])) + 1
    return starts, ends


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` with A-Z lower-cased: polynomials over the
    bytes' numbers from differences of prefix sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        n = int(ends[to - 1] - low)
        powers, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[low : low + n]] * powers[:n], out=sums[1:])
        first = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[first]) * inverse[first]
        at = to
    return mix(out + (ends - starts).astype(np.uint64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and for each text its first word's
    place among them (n + 1 numbers)."""
    data, borders = utf8(column)
    starts, ends = borders_of_words(data, borders)
    return hashes(data, starts, ends), np.searchsorted(starts, borders)


def shingles(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; of the whole text if it has fewer."""
    n = len(hashed)
    if n == 0:
        return hashed
    width = min(k, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashed[i : n - width + 1 + i]
    return mix(out + np.uint64(width))
