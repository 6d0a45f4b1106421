"""Maximal periodic runs of words, found with longest common extensions.

The words of a batch of documents become numbers. Only suffixes at the places of a
difference cover are sorted: first word by word up to the cover's modulus, then by doubling
through the ranks of later samples. Any two places reach a pair of sampled places after the
same few words, so a common extension is a short comparison and then one range minimum over
the common prefixes of neighbouring samples. A second structure over the reversed words
extends to the left.

For each period q, every q-th word of a document is compared with the word q further (a
harmonic grid: about n ln n pairs in all). A run of two periods or more holds such a pair,
and extending the pair both ways gives the run's ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurekit.llm.tables import id_and_text, let
from featurekit.llm.words import slices

#: A perfect difference set: every distance modulo 57 is that of two of its members. Fixed values.
MODULUS = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: Runs of fewer words are none, whatever their period.
MIN_LENGTH = 12
#: Pairs of the grid looked at together.
PAIRS = 1 << 21
#: Times that pairs covered by a longer extension are left out before all others are extended.
ROUNDS = 4

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _meeting() -> np.ndarray:
    """For two places modulo MODULUS, the fewest words after which both are in the cover."""
    inside = np.zeros(MODULUS, bool)
    inside[list(COVER)] = True
    place = np.arange(MODULUS)
    out = np.full((MODULUS, MODULUS), -1, np.int32)
    for step in range(MODULUS - 1, -1, -1):
        there = inside[(place + step) % MODULUS]
        out[there[:, None] & there[None, :]] = step
    return out


_MEETING = _meeting()


class Extensions:
    """Lengths of the longest common extensions of places in the same document.

    symbols: word numbers, a number found nowhere else at both ends of each document.
    document: for each place its document; places of one are together.
    """

    def __init__(self, symbols: np.ndarray, document: np.ndarray):
        self.symbols = symbols
        n = len(symbols)
        inside = np.zeros(MODULUS, bool)
        inside[list(COVER)] = True
        self.places = np.flatnonzero(np.resize(inside, n))
        self.sample = np.full(n, -1, np.int32)
        self.sample[self.places] = np.arange(len(self.places))
        order, levels = self._sort(document)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self._tabulate(self._common(order, levels))

    def _sort(self, document: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Samples by document and then by their words; and, for each doubling, the classes
        of samples that agree on MODULUS * 2^level words."""
        x, places, m = self.symbols, self.places, len(self.places)
        order, positions = np.arange(m), np.arange(m)
        levels: list[np.ndarray] = []
        if not m:
            return order, levels
        of = document[places]
        fresh = np.ones(m, bool)
        fresh[1:] = of[1:] != of[:-1]
        head = np.maximum.accumulate(np.where(fresh, positions, 0))  # first position of the class
        unsettled = positions[~(fresh & np.append(fresh[1:], True))]

        def refine(members: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Cut classes by a further key; the positions that are not settled yet."""
            by = np.argsort(key, kind="stable")
            members, key = members[by], key[by]
            order[at] = members
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            head[members] = np.maximum.accumulate(np.where(fresh, at, 0))
            return at[~(fresh & np.append(fresh[1:], True))]

        width = int(x.max()) + 1
        for t in range(MODULUS):
            if not len(unsettled):
                return order, levels
            members = order[unsettled]
            unsettled = refine(members, unsettled, head[members] * width + x[places[members] + t])
        step = MODULUS
        while len(unsettled):
            levels.append(head.copy())
            members = order[unsettled]
            unsettled = refine(members, unsettled, head[members] * m + head[self.sample[places[members] + step]])
            step *= 2
        return order, levels

    def _common(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sample shares with the next one in order."""
        x, places = self.symbols, self.places
        common = np.zeros(max(len(order) - 1, 0), np.int64)
        if not len(common):
            return common
        left, right = order[:-1].copy(), order[1:].copy()
        for level in range(len(levels) - 1, -1, -1):
            step = MODULUS << level
            same = np.flatnonzero(levels[level][left] == levels[level][right])
            left[same], right[same] = self.sample[places[left[same]] + step], self.sample[places[right[same]] + step]
            common[same] += step
        a, b, active, t = places[left], places[right], np.arange(len(common)), 0
        while len(active):
            # Neighbours of different documents may agree, but are never asked for.
            inside = active if t == 0 else active[(a[active] + t < len(x)) & (b[active] + t < len(x))]
            active = inside[x[a[inside] + t] == x[b[inside] + t]]
            common[active] += 1
            t += 1
            if t == MODULUS:
                break
        return common

    def _tabulate(self, common: np.ndarray) -> None:
        """Minima over all stretches of 2^level neighbours."""
        rows = [common.astype(np.int32 if len(self.symbols) < 2**31 else np.int64)]
        while 2 ** len(rows) <= len(common):
            half = 2 ** (len(rows) - 1)
            row = rows[-1].copy()
            row[:-half] = np.minimum(row[:-half], rows[-1][half:])
            rows.append(row)
        self.minima = np.stack(rows)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different places of one document."""
        x = self.symbols
        reach = _MEETING[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        active = np.arange(len(i))
        meet = []
        for t in range(MODULUS):
            arrived = reach[active] == t
            meet.append(active[arrived])
            active = active[~arrived]
            active = active[x[i[active] + t] == x[j[active] + t]]
            if not len(active):
                break
            out[active] += 1
        met = np.concatenate(meet)
        if len(met):
            a = self.rank[self.sample[i[met] + reach[met]]]
            b = self.rank[self.sample[j[met] + reach[met]]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            out[met] += np.minimum(self.minima[level, low], self.minima[level, high - (1 << level)])
        return out


def _grid(first: np.ndarray, length: np.ndarray, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of pairs (document, place, period): multiples of the period in each document
    that has room for two periods and ``min_length`` words."""
    periods = np.where(length >= min_length, length // 2, 0)
    ends = np.cumsum(periods)
    total = int(ends[-1]) if len(ends) else 0
    at = 0
    while at < total:
        # Rows of the grid: one per document and period.
        row = np.arange(at, min(at + PAIRS, total))
        doc = np.searchsorted(ends, row, "right")
        q = row - (ends - periods)[doc] + 1
        pairs = (length[doc] - 1) // q
        sums = np.cumsum(pairs)
        to = max(1, int(np.searchsorted(sums, PAIRS, "right")))
        doc, q, pairs, sums = doc[:to], q[:to], pairs[:to], sums[:to]
        multiple = np.arange(sums[-1]) - np.repeat(sums - pairs, pairs)
        period = np.repeat(q, pairs)
        yield np.repeat(doc, pairs), np.repeat(first[doc], pairs) + multiple * period, period
        at += to


def runs_of(numbers: np.ndarray, length: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """All runs of the documents whose word numbers stand one after another: document, start,
    length and period of each, by document, start and period."""
    documents = len(length)
    none = np.zeros(0, np.int64)
    if not documents or length.max() < min_length:
        return none, none, none, none
    # A number of its own before each document and after the last one.
    words = int(numbers.max()) + 1
    first = np.cumsum(length + 1) - length
    symbols = np.empty(len(numbers) + documents + 1, np.int64)
    mark = np.append(first - 1, len(symbols) - 1)
    is_word = np.ones(len(symbols), bool)
    is_word[mark] = False
    symbols[is_word], symbols[mark] = numbers, words + np.arange(documents + 1)
    document = np.cumsum(~is_word) - 1
    ahead = back = None
    found, last = [], len(symbols) - 1
    for doc, i, q in _grid(first, length, min_length):
        alike = np.flatnonzero(symbols[i] == symbols[i + q])
        if not len(alike):
            continue
        if ahead is None:
            ahead = Extensions(symbols, document)
            back = Extensions(symbols[::-1].copy(), document[::-1])
        doc, i, q = doc[alike], i[alike], q[alike]
        for rounds in range(ROUNDS):
            # Of pairs one period apart the first stands for all that its extension covers.
            head = np.ones(len(i), bool)
            if rounds < ROUNDS - 1:
                head[1:] = (doc[1:] != doc[:-1]) | (q[1:] != q[:-1]) | (i[1:] - i[:-1] != q[1:])
            at, step, of = i[head], q[head], doc[head]
            after, before = ahead.of(at, at + step), back.of(last - at + 1, last - at - step + 1)
            size = step + after + before
            kept = size >= np.maximum(min_length, 2 * step)
            rows = np.stack([of[kept], (at - before - first[of])[kept], size[kept], step[kept]])
            found.append(_distinct(rows))
            rest = i >= (at + after)[np.cumsum(head) - 1]
            doc, i, q = doc[rest], i[rest], q[rest]
            if not len(i):
                break
    if not found:
        return none, none, none, none
    # A stretch found with several periods has the smallest; its others are multiples.
    doc, start, size, period = _distinct(np.concatenate(found, axis=1))
    by = np.lexsort((period, start, doc))
    return doc[by], start[by], size[by], period[by]


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The smallest period of each (document, start, length)."""
    rows = rows[:, np.lexsort(rows[::-1])]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    return rows[:, fresh]


def find_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (array of start, length, period, counted in words from 0,
    by start and then period) and collapsed, the text's words joined by spaces without those
    that a run holds after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+`` and compared byte by byte. A run is a stretch whose
    words ``period`` apart are equal, that cannot be made longer on either side, of at least
    two periods and ``min_length`` words; the period is its smallest. Null and empty texts
    have no words and an empty collapsed text. Repeated rows are judged one by one; a null
    id stays null; an empty table gives an empty one; other columns are not read. A text of
    any length is held by one task, with about 100 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            words = [t.split() if t else [] for t in texts]  # bytes split at the six bytes of white space
            length = np.array([len(w) for w in words], np.int64)
            flat = pa.array(chain.from_iterable(words), pa.large_binary())
            numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            doc, start, size, period = runs_of(numbers, length, min_length)
            ends = np.cumsum(length)
            first = (ends - length)[doc]
            change = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(change, first + start + period, 1)
            np.add.at(change, first + start + size, -1)
            kept = np.cumsum(change)[:-1] == 0
            collapsed = []
            for w, a, b in zip(words, (ends - length).tolist(), ends.tolist(), strict=True):
                keep = kept[a:b]
                collapsed.append(b" ".join(w if keep.all() else compress(w, keep.tolist())).decode())
            cells = [pa.array(c, pa.int64()) for c in (start, size, period)]
            offsets = np.searchsorted(doc, np.arange(len(words) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(length),
                    pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cells, ["start", "length", "period"])
                    ),
                    pa.array(collapsed, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return id_and_text(docs, doc_id, text).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth (by a hash of its id) repeats a passage of its own to
    the end: with n words, each word i >= a is word a + (i - a) % p. A null id repeats none."""
    read = id_and_text(docs)
    number = F.crc32(F.col("doc_id").cast("string"))

    def tail(words: Column) -> Column:
        n = F.size(words)
        drawn = F.floor(number / 10)
        return let(
            F.struct(n.alias("n"), (drawn % n).alias("a"), (3 + drawn % 8).alias("parts"), words.alias("w")),
            lambda s: let(
                F.struct(s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / s["parts"])).alias("p"), s["w"].alias("w")),
                lambda d: F.array_join(
                    F.transform(
                        d["w"], lambda w, i: F.when(i < d["a"], w).otherwise(F.get(d["w"], (d["a"] + (i - d["a"]) % d["p"]).cast("int")))
                    ),
                    " ",
                ),
            ),
        )

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    repeated = let(words, lambda w: F.when(F.size(w) > 0, tail(w)))
    return read.withColumn("text", F.when(number % 10 == 0, repeated).otherwise(F.col("text")))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: the first, then the smallest
    period; nulls without one), and digests of all runs and of the collapsed text."""
    found = find_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        longest.alias("longest"),
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("longest.col2")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.col3")).alias("period"),
        F.expr("1000 * longest.length div -longest.col3").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
