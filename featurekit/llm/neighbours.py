"""Nearest neighbours by collision counting over single projections.

Unit vectors are projected on random lines. For each line, the projections of a block of
vectors form a sorted array. A query opens a window around its own projection on every line;
virtual rehashing widens all windows step by step, and a vector found in the windows of at
least a threshold share of the lines is compared exactly. A query stops widening once it
holds enough vectors closer than what the next width could still bring with fair chance.

Queries and vectors meet in blocks: vectors by a hash of their id, queries by another, each
pair of blocks one group, so that no task holds more than two blocks and no value of the
data makes a block larger.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = 24
#: Share of the lines on which a vector must collide with the query to be compared.
THRESHOLD = 0.8
#: First half-width of a window, and how it grows. Projections of unit vectors at distance r
#: differ by a normal number with standard deviation r.
WIDTH, GROWTH = 0.4, 1.5
#: The search ends once the k-th best distance is at most this multiple of the half-width.
REACH = 0.7
VECTORS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 8_192

_FOUND = "query_id long, vec_id long, score double"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def lines_for(dimension: int, lines: int = LINES) -> np.ndarray:
    """Random directions, the same in every task."""
    return np.random.default_rng(20_240_229).standard_normal((lines, dimension))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision from the original numbers, each row in the same way."""
    norms = np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
    return (vectors * query).sum(axis=1) / norms


class Block:
    """The sorted arrays of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.directions = lines_for(vectors.shape[1], lines)
        self.unit = unit_rows(self.vectors)
        projected = self.directions @ self.unit.T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best k vectors found, without the query's own id."""
        lines, n = self.sorted.shape
        unit = query / np.sqrt((query * query).sum())
        centre = self.directions @ unit
        least = max(1, int(np.ceil(THRESHOLD * lines)))
        count = np.zeros(n, np.int16)
        seen = self.ids == query_id
        low = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre, strict=True)])
        high = low.copy()
        ids, scores, width = np.zeros(0, np.int64), np.zeros(0), WIDTH
        while True:
            for i in range(lines):  # what this width adds on both sides of each window
                to_low, to_high = self.sorted[i].searchsorted((centre[i] - width, centre[i] + width))
                count[self.order[i, to_low : low[i]]] += 1
                count[self.order[i, high[i] : to_high]] += 1
                low[i], high[i] = min(low[i], to_low), max(high[i], to_high)
            found = np.flatnonzero((count >= least) & ~seen)
            if len(found):
                seen[found] = True
                ids = np.r_[ids, self.ids[found]]
                scores = np.r_[scores, cosines(self.vectors[found], query)]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if seen.all():
                return ids, scores
            # At this distance, a vector shares a window with the chance that a normal number
            # lies within 1 / REACH standard deviations.
            if len(ids) == k and np.sqrt(max(0.0, 2 - 2 * scores[-1])) <= REACH * width:
                return ids, scores
            width *= GROWTH


def _usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    lines: int = LINES,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest vectors found for each query,
    ties to the smaller id; all, if there are fewer.

    score is the cosine of the original vectors in double precision; vectors of the query's
    own id are no candidates. Rows without id, and vectors that are null, empty, zero or
    hold a null or non-finite component take no part on either side; queries only meet
    vectors of their own length. Rows that repeat an id count once. An empty table on either
    side gives an empty result. The search is approximate; its recall is tested.
    """

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
        return rows.where(F.col("id").isNotNull() & _usable(F.col("v"))).dropDuplicates(["id"])

    data, asked = prepared(vectors), prepared(queries)
    blocks = max(1, -(-vectors.count() // VECTORS_PER_BLOCK))
    groups = max(1, -(-queries.count() // QUERIES_PER_BLOCK))

    def numbered(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(column), "id"), F.lit(n)).cast("int").alias(column)

    def every(column: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column)

    left = asked.select("id", "v", F.size("v").alias("d"), numbered("q", groups), every("b", blocks))
    right = data.select("id", "v", F.size("v").alias("d"), numbered("b", blocks), every("q", groups))

    def search(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            block = Block(vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy()), lines)
            for query_id, query in zip(queries["id"], queries["v"], strict=True):
                ids, scores = block.search(query_id, np.asarray(query), k)
                out["query_id"] += [query_id] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["q", "b", "d"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
