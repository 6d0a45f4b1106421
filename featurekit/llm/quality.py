"""Text quality by logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates (FTRL-proximal).

Features of a text are its words and word pairs, and the same for the words' shapes (runs of
upper- or lower-case letters, digits and other characters), hashed to ``BUCKETS`` numbers; a
pair of equal words is a feature of its own. A feature's value is its share of all of the
text's features, so a score is a sparse dot product that does not grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurekit.llm.tables import id_and_text
from featurekit.llm.words import SPACE, borders_of_words, hashes, mix, slices, utf8

BUCKETS = 1 << 18
#: At most so many labelled rows are fitted: those whose doc_id has the smallest hash.
SAMPLE = 20_000
#: Score from which a text is accepted.
THRESHOLD = 0.3

ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
#: The shares are small numbers; this brings them near 1.
SCALE = 10.0

_SHAPE = np.full(256, 3, np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = 1, 2, 4
_SHAPE[128:] = 2  # letters of other alphabets
_SHAPE[[33, 63]] = 5
_SHAPE[[44, 46, 58, 59]] = 6
_SHAPE_NUMBERS = mix(np.arange(257, 513, dtype=np.uint64))
_SAME = np.uint64(0x5DEECE66D)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' features one after another, text by text, and the borders."""
    data, borders = utf8(column)
    starts, ends = borders_of_words(data, borders)
    word = hashes(data, starts, ends)
    shape = _SHAPE[data]
    kept = ~SPACE[data]
    first = np.zeros(len(data), bool)
    first[starts] = True
    if len(data):
        kept[1:] &= first[1:] | (shape[1:] != shape[:-1])
    place = np.r_[0, np.cumsum(kept)]
    outline = hashes(shape[kept], place[starts], place[ends], _SHAPE_NUMBERS)
    first = np.searchsorted(starts, borders)
    n = np.diff(first)
    pairs = np.ones(max(len(word) - 1, 0), bool)  # not across texts
    inner = first[1:-1]
    pairs[inner[(inner > 0) & (inner < len(word))] - 1] = False
    of_text = np.repeat(np.arange(len(n)), n)
    both = mix(word[:-1] * np.uint64(3) + word[1:]) if len(word) else word
    if len(word):
        both[word[:-1] == word[1:]] = _SAME
    shapes = mix(outline[:-1] * np.uint64(5) + outline[1:]) if len(word) else outline
    found = np.concatenate([word, mix(outline), both[pairs], shapes[pairs]])
    owner = np.concatenate([of_text, of_text, of_text[1:][pairs], of_text[1:][pairs]])
    order = np.argsort(owner, kind="stable")
    return (found[order] % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(owner[order], np.arange(len(n) + 1))


class Ftrl:
    """Weights of a logistic regression, updated one text at a time. The last one is the
    bias, whose feature is always 1."""

    def __init__(self, size: int = BUCKETS + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label
        g = error * x
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def learnt_labels(labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, order) of at most ``sample`` labelled documents, those whose doc_id has
    the smallest hash. Only those whose crc32(doc_id as text) modulo ``folds`` is not 0 may
    be learnt from. Labels that repeat count by majority; other values than 0 and 1 and
    rows without doc_id are no labels."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
    quality = known.agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    learn = quality.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    return learn.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (BUCKETS and the bias) learnt from the documents of :func:`learnt_labels`.

    They are read in the order of their hash by one task, in a stream of slices; null texts
    are left out. Without rows all weights are 0.
    """
    # At most ``sample`` rows are broadcast, and their documents meet in one task.
    chosen = id_and_text(docs).join(F.broadcast(learnt_labels(labels, sample=sample)), "doc_id").where("text IS NOT NULL")
    ordered = chosen.repartition(1).sortWithinPartitions("order", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for batch in slices(batches):
            found, borders = features(batch.column("text"))
            labels = batch.column("label").to_pylist()
            for i, label in enumerate(labels):
                at, count = np.unique(found[borders[i] : borders[i + 1]], return_counts=True)
                x = np.r_[count * (SCALE / max(count.sum(), 1)), 1.0]
                model.update(np.r_[at, BUCKETS], x, label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["weights"])

    row = ordered.select("text", "label").mapInArrow(run, "weights binary").first()
    return np.frombuffer(row["weights"], "<f4") if row else np.zeros(BUCKETS + 1, "<f4")


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """Adds a score (0 to 1) to rows with a ``text``; null and empty texts get the bias."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(np.float64)
        for batch in slices(batches):
            found, borders = features(batch.column("text"))
            sums = np.r_[0.0, np.cumsum(w[found])]
            n = np.diff(borders)
            dot = (sums[borders[1:]] - sums[borders[:-1]]) * SCALE / np.maximum(n, 1) + w[-1]
            values = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs; repeated rows get equal
    results, rows without doc_id are never held out nor learnt from."""
    scored = score(id_and_text(docs), fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that :func:`judge` predicts to be good."""
    scored = score(docs, fit(docs, labels), "_score")
    return scored.where(F.col("_score") >= threshold).drop("_score")
