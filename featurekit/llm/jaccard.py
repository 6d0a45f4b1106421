"""Near-duplicate documents: exact Jaccard join of word shingles by parity sketches.

Every shingle flips one bit of a sketch, so two sketches differ in no more bits than their
sets differ in shingles. A pair of sets of sizes a and b is alike only if the sets differ in
at most d = (a + b)(1 - s) / (1 + s) shingles. Within a band of sizes, sketches are cut into
more than d blocks by a hash of the shingle; of an alike pair, at least one block has no
difference (pigeonhole), so joining equal blocks loses no pair. There are some blocks more
than that, so an alike pair shares more than the spare number, and each document may leave
out that many of its blocks: those that most documents share (a common passage, nothing at
all), by one order for all. Candidates are filtered by the Hamming distance of whole
sketches and verified on their sets.

Exact copies of a set meet only once: each task sends the blocks of the first of them, and
later steps replace a document by the first with an equal set.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurekit.llm.links import connect, pairs_between, shared_buckets
from featurekit.llm.tables import id_and_text, release, written
from featurekit.llm.words import mix, shingles, slices, words

#: Bits of a sketch: so many for each shingle in which alike sets of its size may differ, a power
#: of two, and at least these. Narrow sketches of small sets that share a passage tell too little.
BITS_PER_DIFFERENCE, LEAST_BITS = 8, 1024
#: Blocks beyond the pigeonhole's number, as a share of it.
SPARE = 0.25

_SETS = "doc_id long, n_shingles long, sign_a long, sign_b long, sketch array<long>"


class Bands:
    """Bands of set sizes and, for each, how many blocks its sketches have.

    A set joins its own band and, if it can be alike to a larger set of the next band, that
    one too. So each pair of sizes that can be alike shares the larger one's band.
    """

    def __init__(self, similarity: Fraction):
        self.similarity = similarity
        ratio = (1 / similarity) ** 3
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * ratio)))

    @functools.cache  # noqa: B019
    def blocks(self, band: int) -> tuple[int, int]:
        """(number of blocks, how many of them a document may leave out); (0, 0) if only
        equal sets are alike."""
        largest = self.starts[band + 1] - 1
        differ = int(2 * largest * (1 - self.similarity) / (1 + self.similarity))
        if differ == 0:
            return 0, 0
        spare = math.ceil((differ + 1) * SPARE)
        return differ + 1 + spare, spare

    def of(self, n: int) -> list[int]:
        band = int(np.searchsorted(self.starts, n, "right")) - 1
        return [band] + [band + 1] * (n >= self.similarity * self.starts[band + 1])


def block_keys(found: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of one document's distinct shingles and their bands: for each band and
    block a hash of the block's parity bits, checksum and size."""
    out, of_band = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    bit = np.uint64(1) << (found & np.uint64(63))
    for band in bands.of(len(found)):
        blocks, spare = bands.blocks(band)
        if not blocks:
            continue
        block = (found >> np.uint64(8)) % np.uint64(blocks)
        order = np.argsort(block)
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        parity = np.bitwise_xor.reduceat(bit[order], first)
        check = np.bitwise_xor.reduceat(found[order], first)
        size = np.diff(np.r_[first, len(block)]).astype(np.uint64)
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[first])
        filled = np.r_[block[first], empty]
        parity, check, size = (np.r_[x, np.zeros(len(empty), np.uint64)] for x in (parity, check, size))
        place = np.full(1, band, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + filled
        out.append(mix(mix(mix(place) + parity) + check + size))
        of_band.append(np.full(blocks, band, np.int32))
    return np.concatenate(out), np.concatenate(of_band)


def _sets_of(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    hashed, first = words(batch.column("text"))
    return [np.unique(shingles(hashed[a:b], k)) for a, b in zip(first, first[1:], strict=False)]


def _sign(found: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a, b = np.bitwise_xor.reduce(found), mix(found).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sketch_of(found: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Parity bits, as 64-bit words; more of them for sets that may differ in more shingles. A
    sketch of half the bits is both halves' XOR."""
    differ = int(2 * len(found) * (1 - similarity) / (1 + similarity))
    bits = max(LEAST_BITS, 1 << (BITS_PER_DIFFERENCE * differ).bit_length())
    odd = np.bincount(((found >> np.uint64(16)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def sketches_differ(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the wider one is folded to the other's width. Sets of
    sizes that can be alike have widths that differ by a factor of two at most."""

    def folded(x: Column, width: Column) -> Column:
        half = F.zip_with(F.slice(x, F.lit(1), width), F.slice(x, width + 1, width), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) == 2 * width, half).otherwise(x)

    width = F.least(F.size(a), F.size(b))
    xor = F.zip_with(folded(a, width), folded(b, width), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return F.aggregate(xor, F.lit(0).cast("long"), lambda s, x: s + x)


def signed_sets(docs: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """Size, 128-bit sign and sketch of every document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = _sets_of(batch, k)
            signs = [_sign(s) for s in sets]
            sketches = [sketch_of(s, similarity) for s in sets]
            flat = pa.array(np.concatenate(sketches))
            ends = pa.array(np.cumsum([0, *map(len, sketches)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s[0] for s in signs], pa.int64()),
                    pa.array([s[1] for s in signs], pa.int64()),
                    pa.ListArray.from_arrays(ends, flat),
                ],
                names=["doc_id", "n_shingles", "sign_a", "sign_b", "sketch"],
            )

    return docs.mapInArrow(run, _SETS)


def _buckets(docs: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """(key, id, band): the block keys of the first of each task's equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(similarity), set()
        for batch in slices(batches):
            keys, ids, of_band = [], [], []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), _sets_of(batch, k), strict=True):
                sign = _sign(found)
                if len(found) and sign not in seen:
                    seen.add(sign)
                    own, band = block_keys(found, bands)
                    keys.append(own)
                    of_band.append(band)
                    ids.append(np.full(len(own), doc_id, np.int64))
            if keys:
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(of_band)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "band"])

    return docs.mapInArrow(run, "key long, id long, band int")


def _shared(blocks: DataFrame, similarity: Fraction) -> DataFrame:
    """(key, id) of the blocks that other documents have too, without each document's most
    common ones: as many of each band as may be left out. Blocks that nobody shares come
    first in the order, so they make up for shared ones that are kept."""
    of_key = Window.partitionBy("key")
    shared = F.min("id").over(of_key) < F.max("id").over(of_key)
    counted = blocks.select("key", "id", "band", shared.alias("shared"), F.count("*").over(of_key).alias("size"))
    bands = Bands(similarity)
    spare = F.array(*[F.lit(bands.blocks(b)[1]) for b in range(len(bands.starts) - 1)])
    common_first = Window.partitionBy("id", "band").orderBy(F.desc("size"), "key")
    ranked = counted.where("shared").withColumn("rank", F.row_number().over(common_first))
    return written(ranked.where(F.col("rank") > F.get(spare, F.col("band"))).select("key", "id"))


def _packed(docs: DataFrame) -> DataFrame:
    """(id, size, packed): texts compressed one by one, smaller than their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in slices(batches):
            data = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            columns = [pa.array([len(t) for t in data], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in data], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["id", "size", "packed"])

    return docs.mapInArrow(run, "id long, size long, packed binary")


def _verified(pairs: DataFrame, k: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are alike, from rows with both packed texts. Rows come in
    order of a, so its set is made once."""
    top, whole = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last = pa.Codec("zstd"), (None, None)

        def set_of(size: int, packed: bytes) -> np.ndarray:
            hashed, _ = words(pa.array([codec.decompress(packed, size, asbytes=True)], pa.binary()).cast(pa.string()))
            return np.unique(shingles(hashed, k))

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            kept = []
            for i in range(batch.num_rows):
                if last[0] != a[i]:
                    last = (a[i], set_of(batch.column("a_size")[i].as_py(), batch.column("a_packed")[i].as_py()))
                one, other = last[1], set_of(batch.column("b_size")[i].as_py(), batch.column("b_packed")[i].as_py())
                common = len(np.intersect1d(one, other, assume_unique=True))
                kept.append(common * whole >= (len(one) + len(other) - common) * top)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document.

    Words are runs of anything but white space, with A-Z lower-cased; a document's set is
    its distinct runs of k words, or its whole word sequence if it has fewer. Two documents
    are linked if their sets' Jaccard similarity is at least ``similarity``; component_id
    is the smallest doc_id that links reach. Null texts and texts without words are empty
    sets, linked with nothing. Rows without doc_id are left out; of rows that repeat a
    doc_id one counts. Very long texts take part whole. No documents, no rows.
    """
    read = id_and_text(docs, doc_id, text).where("doc_id IS NOT NULL")
    signed = written(signed_sets(read, k, similarity).dropDuplicates(["doc_id"]))
    equal = ["n_shingles", "sign_a", "sign_b"]
    firsts = signed.where("n_shingles > 0").groupBy(*equal).agg(F.min("doc_id").alias("first"), F.count("*").alias("_copies"))
    copies = signed.join(firsts.where("_copies > 1"), equal).select(F.col("doc_id").alias("id"), "first")
    copies = written(copies.where("id != first"))

    shared = _shared(_buckets(read, k, similarity), similarity)
    buckets = shared.join(copies, "id", "left").select("key", F.coalesce("first", "id").alias("id")).distinct()
    buckets = shared_buckets(buckets)
    involved = buckets.select(F.col("id").alias("doc_id")).distinct()
    texts = _packed(read).join(involved.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    texts = written(texts.dropDuplicates(["id"]))
    sketches = written(signed.join(involved, "doc_id").select(F.col("doc_id").alias("id"), "n_shingles", "sketch"))
    top, whole = similarity.numerator, similarity.denominator

    total = F.col("a_n_shingles") + F.col("b_n_shingles")
    differ = sketches_differ(F.col("a_sketch"), F.col("b_sketch"))
    sizes = F.least("a_n_shingles", "b_n_shingles") * whole >= F.greatest("a_n_shingles", "b_n_shingles") * top
    near = sizes & (differ * (whole + top) <= total * (whole - top))

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c != "id"])

    def alike(pairs: DataFrame) -> DataFrame:
        close = written(pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").where(near).select("a", "b"))
        if not close.take(1):
            return close
        # A pair's texts move, not its sets; only the first of the two moves once per pair.
        found = written(_verified(close.join(side(texts, "a"), "a").join(side(texts, "b"), "b"), k, similarity))
        release(close)
        return found

    linked = connect(buckets, alike, lambda rows: pairs_between(rows.join(sketches, "id"), near))
    release(shared, buckets, texts, sketches)
    # Copies share the class of their first; a star each, not pairs.
    of_first = copies.join(linked.select(F.col("id").alias("first"), "component"), "first", "left")
    of_copies = of_first.select("id", F.coalesce("component", "first").alias("component"))
    classes = linked.join(copies, "id", "left_anti").unionByName(of_copies).withColumnRenamed("id", "doc_id")
    return signed.join(classes, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def without_near_duplicates(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """One document of each class stays, that of the smallest doc_id; rows without doc_id
    and empty texts stay."""
    others = near_duplicates(docs, k, similarity).where("doc_id != component_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
