"""Benchmark items in documents, also with other numbers, names or units.

Texts become canonical tokens: numbers, names (capitalised inside a sentence) and units
(after a number) turn into typed placeholders, other words into their lower-cased letters.
Windows of canonical tokens are joined by hash, and so are windows of the lower-cased words
themselves, so that word-for-word copies are found whatever their placeholders and their case.
Hits on one diagonal (place in the document less place in the item) form a match. In a match
each original value of a placeholder must stand for one value only; if one does not, only the
equal tokens count, and they must be most of the match, or it is a chance one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurekit.llm.tables import id_and_text, written
from featurekit.llm.words import borders_of_words, hashes, mix, slices, utf8

WINDOW = 8
#: A match counts if it covers this share of its item, or this many tokens.
LEAST_SHARE = 0.5
LONG_RUN = 13
#: A match in which a value stands for several needs this share of equal tokens.
NEAR_SHARE = 0.75

# Units after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "foot", "mile", "miles", "yd", "yard", "yards",
    "mg", "g", "kg", "t", "lb", "lbs", "oz", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "percent", "degree", "degrees", "dollar", "dollars",
    "euro", "euros", "cent", "cents", "mph", "kmh", "hz", "kw", "w", "v", "gb", "mb", "kb",
)

#: Bits of the filter of item windows that is sent to the executors, whatever the benchmark.
FILTER_BITS = 1 << 22
_BITMAP = 32768  # bits of one of Spark's bitmaps

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1F3D5B79, 0x2A4C6E80, 0x3B5D7F91))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CORE = _DIGIT | _UPPER  # letters, digits and everything that is not ASCII
_CORE[97:123] = True
_CORE[128:] = True
_LETTER = _CORE & ~_DIGIT


def _next(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place from ``at`` on that is flagged (the length, if none is)."""
    places = np.flatnonzero(flags)
    return np.r_[places, len(flags)][np.searchsorted(places, at)]


def _last(flags: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The last flagged place before ``before`` (-1, if none is)."""
    places = np.flatnonzero(flags)
    return np.r_[-1, places][np.searchsorted(places, before)]


def _unit_hashes() -> np.ndarray:
    data, borders = utf8(pa.array([" ".join(UNITS)]))
    return np.sort(hashes(data, *borders_of_words(data, borders)))


_UNIT_HASHES = _unit_hashes()


def canonical(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical tokens of all texts, the values behind placeholders (0 for other tokens),
    and each text's first token (n + 1 numbers)."""
    data, borders = utf8(column)
    starts, ends = borders_of_words(data, borders)
    core = _CORE[data]
    first, last = _next(core, starts), _last(core, ends)
    real = first < ends  # not punctuation only
    closing = np.isin(data[ends - 1], np.frombuffer(b".!?:", np.uint8)) if len(ends) else np.zeros(0, bool)
    if len(starts):
        lines = np.r_[0, np.cumsum(data == 10)]
        line = lines[starts]
        opens = np.r_[True, closing[:-1] | (line[1:] != line[:-1])]
        opens[np.isin(starts, _next(~np.isin(data, [9, 10, 11, 12, 13, 32]), borders[:-1]))] = True
    else:
        opens = np.zeros(0, bool)
    first, last, opens = first[real], last[real] + 1, opens[real]
    tokens = hashes(data, first, last)
    values = np.zeros(len(tokens), np.uint64)
    if len(tokens):
        digits, letters = np.r_[0, np.cumsum(_DIGIT[data])], np.r_[0, np.cumsum(_LETTER[data])]
        number = (digits[last] > digits[first]) & (letters[last] == letters[first])
        accented = (data[first] == 0xC3) & (data[np.minimum(first + 1, len(data) - 1)] < 0x9F)
        name = (_UPPER[data[first]] | accented) & ~opens & ~number
        unit = np.r_[False, number[:-1]] & np.isin(tokens, _UNIT_HASHES) & ~name
        for flags, sign in ((number, _NUMBER), (name, _NAME), (unit, _UNIT)):
            values[flags] = tokens[flags]
            tokens[flags] = sign
    return tokens, values, np.searchsorted(first, borders)


def windows(tokens: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(tokens) - width + 1), np.uint64)
    for i in range(width if len(out) else 0):
        out = out * np.uint64(0x9FB21C651E98DF25) + tokens[i : len(out) + i]
    return mix(out + np.uint64(width))


_RAW = np.uint64(0x5D1B8FA3C4E7)  # tells windows of words from windows of canonical tokens


_WINDOWS = "id long, hash long, pos int, values array<long>, n_tokens int"


def _window_rows(texts: DataFrame, widths: dict[int, int] | None, width: int, wanted: bytes | None) -> DataFrame:
    """(id, hash, pos, values, n_tokens). Of items (``wanted`` is None), the windows of words
    and the canonical ones that are no more than half placeholders, or those of the whole item
    if it is shorter. Of documents, the windows of all widths in use that the filter lets
    through. values: what is behind the placeholders; in a window of words, the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little").view(bool)
        for batch in slices(batches):
            tokens, values, first = canonical(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            raw = np.where(values != 0, values, tokens)
            kinds = ((tokens, values, np.uint64(0)), (raw, raw, _RAW))
            for w, (kind, behind, sign) in itertools.product(sorted(widths) if widths else range(1, width + 1), kinds):
                found = windows(kind, w) ^ sign
                if not len(found):
                    continue
                at = np.arange(len(found))
                owner = np.searchsorted(first, at, "right") - 1
                sizes = first[owner + 1] - first[owner]
                keep = at + w <= first[owner + 1]
                if bits is not None:
                    keep &= bits[(found & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
                elif w < width:
                    keep &= sizes == w
                elif not sign:
                    slots = np.r_[0, np.cumsum(values != 0)]
                    keep &= 2 * (w - (slots[at + w] - slots[at])) >= w
                at = at[keep]
                parts.append((ids[owner[keep]], found[keep], at - first[owner[keep]], behind[at[:, None] + np.arange(w)].ravel(), np.full(len(at), w), sizes[keep]))
            if not parts:
                continue
            owner, found, pos, slots, widths_of, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            ends = np.r_[0, np.cumsum(widths_of)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owner),
                    pa.array(found.view(np.int64)),
                    pa.array(pos.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(slots.view(np.int64))),
                    pa.array(sizes.astype(np.int32)),
                ],
                names=["id", "hash", "pos", "values", "n_tokens"],
            )

    return texts.mapInArrow(run, _WINDOWS)


def _filter_of(items: DataFrame) -> bytes:
    """A bitmap of the windows' hashes: FILTER_BITS bits whatever the number of items. It
    lets through some windows that no item has, and never holds back one that an item has."""
    slot = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = items.groupBy(F.floor(slot / _BITMAP).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot % _BITMAP + 1)).alias("bits")
    )
    out = bytearray(FILTER_BITS // 8)
    for row in parts.collect():  # at most FILTER_BITS / _BITMAP rows
        out[row["part"] * _BITMAP // 8 : (row["part"] + 1) * _BITMAP // 8] = row["bits"]
    return bytes(out)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    least_share: float = LEAST_SHARE,
    long_run: int = LONG_RUN,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_matched, first_token, changed): documents that hold a
    benchmark item, the best match of each pair.

    n_item and n_matched count tokens of the item and of those on the diagonal that matching
    windows cover; changed counts placeholders whose value differs from the item's. If a value
    of the item stands for several in the document, n_matched counts the equal tokens only.
    Items of fewer than ``width`` tokens must match whole; items that are mostly placeholders
    throughout are found word for word only, in any case of letters. Null and empty texts on
    either side match nothing; rows without an id are left out; rows that repeat an id count
    once. Texts of any length are searched whole. The items are joined, not broadcast by
    hand, so a large benchmark shuffles.
    """
    items = id_and_text(benchmark, item_id, item_text).where("doc_id IS NOT NULL")
    items = written(_window_rows(items, None, width, None))
    sizes = {r[0] for r in items.select(F.least(F.size("values"), F.lit(width))).distinct().collect()}  # at most ``width``
    read = id_and_text(docs, doc_id, text).where("doc_id IS NOT NULL")
    found = _window_rows(read, dict.fromkeys(sizes or {width}), width, _filter_of(items)).drop("n_tokens")
    item = items.select(F.col("id").alias("item_id"), "hash", F.col("pos").alias("item_pos"), F.col("values").alias("item_values"), F.col("n_tokens").alias("n_item"))
    hits = found.join(item, "hash").select(
        F.col("id").alias("doc_id"), "item_id", "n_item", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "values", "item_values"
    )
    # Window by window first: a slot's value in both texts, by its place in the item.
    slots = F.transform(
        F.arrays_zip("item_values", "values"),
        lambda x, i: F.struct((F.col("item_pos") + i).alias("place"), x["item_values"].alias("item"), x["values"].alias("doc")),
    )
    diagonal = hits.groupBy("doc_id", "item_id", "n_item", "diagonal").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(slots)))).alias("covered")
    )
    filled = F.filter("covered", lambda x: x["item"] != 0)

    def distinct(*parts: str):
        return F.size(F.array_distinct(F.transform(filled, lambda x: F.struct(*[x[p].alias(p) for p in parts]))))

    def places(kept: Column):
        return F.size(F.array_distinct(F.transform(kept, lambda x: x["place"])))

    consistent = distinct("item") == distinct("item", "doc")
    covering = places(F.col("covered"))
    equal = places(F.filter("covered", lambda x: x["item"] == x["doc"]))
    diagonal = diagonal.withColumn("matched", F.when(consistent, covering).when(equal >= NEAR_SHARE * covering, equal).otherwise(0))
    matched = F.col("matched")
    enough = (matched >= least_share * F.col("n_item")) | (matched >= long_run)
    good = diagonal.where((matched > 0) & enough).select(
        "doc_id", "item_id", "n_item", matched.alias("n_matched"),
        (F.col("diagonal") + F.get("covered", F.lit(0))["place"]).alias("first_token"),
        F.size(F.filter(filled, lambda x: x["item"] != x["doc"])).alias("changed"),
    )
    best = F.max(F.struct("n_matched", (-F.col("changed")).alias("kept"), (-F.col("first_token")).alias("early"))).alias("best")
    return good.groupBy("doc_id", "item_id", "n_item").agg(best).select(
        "doc_id", "item_id", "n_item", "best.n_matched", (-F.col("best.early")).alias("first_token"), (-F.col("best.kept")).alias("changed")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without doc_id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
