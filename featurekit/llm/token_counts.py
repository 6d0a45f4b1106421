"""Token counts that follow edits without encoding a document again.

A document is split into pre-tokens, each of which is encoded on its own. Pre-tokens are
gathered in leaves of about ``LEAF`` pre-tokens, and a segment tree over the leaves holds
sums of characters and tokens. An edit finds its leaves by descending the tree, splits
again only from shortly before the edited region until the pre-tokens meet the old ones,
encodes what is new, and updates the sums on the way up.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurekit.llm.tables import id_and_text
from featurekit.llm.words import slices

LEAF = 64
#: A pre-token's match may depend on so many characters after its end (the pattern looks
#: past white space to the next character, and tries contractions of three characters).
CONTEXT = 2
CACHE = 200_000

#: Personal data and secrets that the query removes, and what takes their place.
REDACTIONS = (
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", "<email>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
    (r"\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}", "<secret>"),
    (r"\+?\d[\d ()-]{7,}\d", "<phone>"),
)


class Tree:
    """Pre-tokens of one text in leaves, with sums over ranges of leaves.

    A leaf is (text, lengths of its pre-tokens, their tokens). Node 1 is the root, node i has
    the children 2 i and 2 i + 1, and leaf j is node ``width`` + j; an edit that changes the
    number of leaves keeps their places by letting a leaf grow or become empty.
    """

    def __init__(self, text: str, split: Callable[[str, int], Iterable[int]], count: Callable[[str], int]):
        self.split, self.count, self.encoded = split, count, 0
        self.leaves: list[tuple[str, list[int], list[int]]] = []
        at, ends = 0, []
        for end in split(text, 0):
            ends.append(end)
            if len(ends) == LEAF:
                at = self._add(text, at, ends)
                ends = []
        if ends:
            self._add(text, at, ends)
        self.width = 1
        while self.width < max(1, len(self.leaves)):
            self.width *= 2
        self.leaves += [("", [], [])] * (self.width - len(self.leaves))
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for j in range(self.width):
            self._sum_leaf(j)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _add(self, text: str, start: int, ends: list[int]) -> int:
        borders = [start, *ends]
        counts = [self.count(text[a:b]) for a, b in zip(borders, ends, strict=False)]
        self.encoded += len(ends)
        self.leaves.append((text[start : ends[-1]], [b - a for a, b in zip(borders, ends, strict=False)], counts))
        return ends[-1]

    def _sum_leaf(self, j: int) -> None:
        self.chars[self.width + j] = len(self.leaves[j][0])
        self.tokens[self.width + j] = sum(self.leaves[j][2])

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one that is not empty, at the end),
        and where that leaf starts."""
        node, start = 1, 0
        place = max(0, min(place, self.chars[1] - 1))
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end."""
        first, at = self._leaf_at(start - CONTEXT - 1)
        # Pre-tokens that end early enough before the edit stay.
        text, lengths, counts = self.leaves[first]
        kept, reach = 0, at
        while kept < len(lengths) and reach + lengths[kept] + CONTEXT <= start:
            reach += lengths[kept]
            kept += 1
        last, last_at = self._leaf_at(end)
        middle = "".join(self.leaves[j][0] for j in range(first, last + 1))
        begin = last_at + len(self.leaves[last][0])  # where the leaves not taken yet start
        middle = middle[: start - at] + new + middle[end - at :]
        grown = start - at + len(new)  # end of the edit within ``middle``
        shift = len(new) - (end - start)
        # Old borders after the edit, in new places: from one that is met again, all is as before.
        old, borders = last_at, {}
        for i, n in enumerate(self.leaves[last][1]):
            if old >= end:
                borders[old + shift - at] = (last, i)
            old += n
        fresh: list[int] = []
        while True:
            fresh, joined = [], None
            for place in self.split(middle, reach - at):
                fresh.append(place)
                if place >= grown and place in borders:
                    joined = borders[place]
                    break
            # Near the end of what was taken, a pre-token may go on in the next leaf.
            if joined is not None and fresh[-1] + CONTEXT <= len(middle):
                break
            if last + 1 >= self.width or begin >= self.chars[1]:
                break
            last += 1
            old = begin
            for i, n in enumerate(self.leaves[last][1]):
                borders[old + shift - at] = (last, i)
                old += n
            middle += self.leaves[last][0]
            begin += len(self.leaves[last][0])
        ends = [reach - at, *fresh]
        new_lengths = [b - a for a, b in zip(ends, fresh, strict=False)]
        new_counts = [self.count(middle[a:b]) for a, b in zip(ends, fresh, strict=False)]
        self.encoded += len(fresh)
        stop = fresh[-1] if fresh else reach - at
        lengths, counts = lengths[:kept] + new_lengths, counts[:kept] + new_counts
        if joined is not None:
            leaf, i = joined
            rest = self.leaves[leaf]
            lengths, counts = lengths + rest[1][i:], counts + rest[2][i:]
            stop += sum(rest[1][i:])
            last = max(last, leaf)
            for j in range(leaf + 1, last + 1):
                lengths, counts = lengths + self.leaves[j][1], counts + self.leaves[j][2]
                stop += len(self.leaves[j][0])
        self._put(first, last, middle[:stop], lengths, counts)

    def _put(self, first: int, last: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Deal pre-tokens to the leaves first .. last in equal runs, and sum upwards."""
        leaves, at = last - first + 1, 0
        for k in range(leaves):
            a, b = len(lengths) * k // leaves, len(lengths) * (k + 1) // leaves
            n = sum(lengths[a:b])
            self.leaves[first + k] = (text[at : at + n], lengths[a:b], counts[a:b])
            at += n
            self._sum_leaf(first + k)
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


def _coder(rank_file: str, pattern: str) -> tuple[Callable, Callable]:
    """split(text, start): ends of the pre-tokens from start on; count(pre-token): tokens."""
    import regex
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    find = regex.compile(pattern).finditer
    known: dict[str, int] = {}

    def split(text: str, start: int) -> Iterator[int]:
        return (m.end() for m in find(text, start))

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            if len(known) >= CACHE:
                known.clear()
            n = known[piece] = len(encoding.encode_ordinary(piece))
        return n

    return split, count


def redaction_edits(text: Column, redactions=REDACTIONS) -> Column:
    """array<struct<find string, put string>>: what to replace, in order; each stands for
    all its places."""

    def places(pattern: str, put: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
        return F.transform(found, lambda x: F.struct(x.alias("find"), F.lit(put).alias("put")))

    return F.concat(*[places(*r) for r in redactions])


_COUNTS = "doc_id long, n_chars long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, n_encoded long, n_encoded_again long"


def count_edited(
    docs: DataFrame, rank_file: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", edits: str = "edits"
) -> DataFrame:
    """Tokens of each document before and after its edits, one row per row of docs.

    edits: array<struct<find string, put string>>, applied one after another; each replaces
    all places of ``find`` from left to right, without looking into what it has put.
    Null edits are none; an edit with a null or empty ``find`` is skipped, a null ``put`` deletes.
    Null texts are empty. n_encoded counts pre-tokens of the first encoding, n_encoded_again
    those that the edits had encoded. A text of any length is held by one task, with its tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = _coder(rank_file, pattern)
        for batch in slices(batches):
            rows = []
            for doc, text, edits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "edits")), strict=True):
                tree = Tree(text or "", split, count)
                before, first, done, now = tree.total, tree.encoded, 0, text or ""
                for edit in edits or []:
                    find, put = (edit or {}).get("find"), (edit or {}).get("put") or ""
                    at = now.find(find) if find else -1
                    if at < 0:
                        continue
                    while at >= 0:
                        tree.edit(at, at + len(find), put)
                        now = now[:at] + put + now[at + len(find) :]
                        done += 1
                        at = now.find(find, at + len(put))
                rows.append((doc, len(text or ""), before, done, tree.length, tree.total, first, tree.encoded - first))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in _COUNTS.split(", ")])

    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{edits}`").alias("edits"))
    return read.mapInArrow(run, _COUNTS)


def count_redacted(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Token counts before and after personal data and secrets are replaced."""
    read = id_and_text(docs)
    return count_edited(read.withColumn("edits", redaction_edits(F.coalesce("text", F.lit("")))), rank_file, pattern)
