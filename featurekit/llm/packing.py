"""Best-fit packing of documents into token sequences by matching large items.

Two large pieces (above a third of the capacity) fit a sequence at most, so they are matched
greedily first: each size, from the largest on, with the largest partner that still fits.
Smaller pieces then go, in falling size, to the smallest gap that holds them. Both steps
work on the histogram of lengths (at most ``capacity`` numbers, whatever the input), so the
plan is made on the driver in terms of counts; the pieces themselves stay distributed and
find their place by (length, rank among equal lengths).
"""

from __future__ import annotations

import bisect
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurekit.llm.tables import id_and_text, written
from featurekit.llm.words import slices

CAPACITY = 2048
#: White-space-free chunks whose ids a worker keeps.
CACHE_CHUNKS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


#: The vocabulary file's own pre-token rule (fixed value), for characters below U+0250,
#: whose classes and cases no Unicode version changes.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_BELOW = "\u0250"


def _byte_letters() -> dict[str, str]:
    """Byte-level vocabularies write each byte as a visible character: printable ones as
    themselves, the others as the characters from U+0100 on. Here by character."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in visible]
    letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {chr(c): "".join(letter[b] for b in chr(c).encode()) for c in range(ord(_PLAIN_BELOW))}


def _encoder(path: str, end_id: int):
    """A function from UTF-8 texts to little-endian unsigned 32-bit ids, an end id last.

    The tokenizer lower-cases, drops white space and looks at nothing beyond it, so ids
    are remembered per chunk between ASCII white space. Of a new chunk, the pre-tokens are
    looked up, and only new ones go through the BPE model. Chunks with rarer characters
    or special tokens are encoded by the tokenizer as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    pre_tokens = regex.compile(_PRE_TOKENS).findall
    letters = _byte_letters()
    chunks: dict[bytes, bytes] = {}
    parts: dict[str, bytes] = {}
    end = array("I", [end_id]).tobytes()

    def part(piece: str) -> bytes:
        if len(parts) >= CACHE_CHUNKS:
            parts.clear()
        shown = "".join([letters[c] for c in piece])
        parts[piece] = ids = array("I", [t.id for t in model.tokenize(shown)]).tobytes()
        return ids

    def pieces_of(word: str) -> list[str]:
        if word.isalpha():
            return [word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return pre_tokens(word)

    def add(missing: list[bytes]) -> None:
        odd = []
        for chunk in missing:
            word = chunk.decode("utf-8", "replace")
            lower = word.lower()
            if (word.isascii() or max(word + lower) < _PLAIN_BELOW) and "<|" not in word:
                chunks[chunk] = b"".join([parts.get(p) or part(p) for p in pieces_of(lower)])
            else:
                odd.append((chunk, word))
        found = tokenizer.encode_batch_fast([word for _, word in odd], add_special_tokens=False)
        chunks.update((chunk, array("I", e.ids).tobytes()) for (chunk, _), e in zip(odd, found, strict=True))

    def encode(texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        missing = {c for words in split for c in words}.difference(chunks)
        if len(chunks) + len(missing) > CACHE_CHUNKS:
            chunks.clear()
            missing = {c for words in split for c in words}
        add(list(missing))
        return [b"".join(map(chunks.__getitem__, words)) + end for words in split]

    return encode


def pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Token ids of every document, an end id after them, cut at ``capacity``: (doc_id,
    piece from 0, start, length, ids as little-endian unsigned 32-bit numbers).

    A null text is an empty one: its only id is the end. Rows are encoded one by one, so
    repeated rows and null doc_ids give pieces of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_file, end_id)
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            encoded = encode([t or b"" for t in texts])
            owner, piece, ids = [], [], []
            for i, e in enumerate(encoded):
                for k, at in enumerate(range(0, len(e), 4 * capacity)):
                    owner.append(i)
                    piece.append(k)
                    ids.append(e[at : at + 4 * capacity])
            piece = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    pa.array(piece),
                    pa.array(piece.astype(np.int64) * capacity),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return id_and_text(docs, doc_id, text).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, count, sequence, offset): the pieces of this length with ranks
    first .. first + count - 1 go, in order, to the sequences from ``sequence`` on, at
    ``offset``. counts: pieces of each length."""
    rows: list[tuple[int, int, int, int, int]] = []
    left = {size: n for size, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    made = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number)
    order: list[int] = []  # the gaps there are

    def place(size: int, n: int, sequence: int, offset: int) -> None:
        rows.append((size, used[size], n, sequence, offset))
        used[size] += n
        left[size] -= n

    def add_gap(gap: int, sequence: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((sequence, n))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    rising = large[::-1]
    for size in large:
        while left[size]:
            at = bisect.bisect_right(rising, min(size, capacity - size)) - 1
            while at >= 0 and (left[rising[at]] < (2 if rising[at] == size else 1)):
                at -= 1
            if at < 0:
                n = left[size]
                place(size, n, made, 0)
                add_gap(capacity - size, made, n)
            else:
                other = rising[at]
                n = left[size] // 2 if other == size else min(left[size], left[other])
                place(size, n, made, 0)
                place(other, n, made, size)
                add_gap(capacity - size - other, made, n)
            made += n
        rising.pop()

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                sequence, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                taken = min(n, left[size])
                place(size, taken, sequence, capacity - gap)
                add_gap(gap - size, sequence, taken)
                add_gap(gap, sequence + taken, n - taken)
            else:
                each = min(capacity // size, left[size])
                n = left[size] // each
                for layer in range(each):
                    place(size, n, made, layer * size)
                add_gap(capacity - each * size, made, n)
                made += n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``;
    other columns pass (columns of these names are replaced). The pieces of a sequence
    lie without gaps from 0. No pieces, no rows.

    The pieces are written once with the number of the writing task and of the row, so
    that a repeated task cannot change ranks that others rely on. Ranks among equal lengths
    are counted per task and shifted by the tasks before, so a length that a third of all
    pieces have is no hot key.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_task", "_row")]
    numbered = [F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_row")]
    stored = written(pieces.select(*[F.col(f"`{c}`") for c in columns], *numbered))
    per_task = stored.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Some rows for each length: its size depends on the capacity, not on the input.
    places = pieces.sparkSession.createDataFrame(
        plan(counts, capacity), "_length long, _first long, _count long, _sequence long, _offset long"
    )
    within = Window.partitionBy("_task", "length").orderBy("_row")
    ranked = stored.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(starts, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    found = ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_first"))
        & (F.col("_rank") < F.col("_first") + F.col("_count")),
    )
    return found.select(
        *[F.col(f"`{c}`") for c in columns],
        (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from packed pieces that still carry their ``ids``. A
    sequence holds at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.array_join(F.transform("_parts", lambda x: F.hex(x["ids"])), "")
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_parts"))
    return grouped.select("sequence_id", "n_tokens", F.unhex(joined).alias("ids"))
