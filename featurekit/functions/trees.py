"""Helpers on one batch of rows inside a task: walking trees, summing gradients, weighted
quantile summaries."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

# Node arrays of a tree; leaves have feature -1. ``cut`` is a bin number while training
# on bins (left when bin <= cut) and a feature value otherwise (left when x <= cut).
NODE_FIELDS = ("feature", "cut", "default_left", "left", "right", "value")
# Rows put together before they are summed: each sum passes over all cells of a feature.
ROWS_PER_SUM = 1 << 16


def leaf_of(tree: dict, columns: np.ndarray, missing: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Node each row ends in, from the root or a node per row. ``columns`` and ``missing``
    are (rows, features)."""
    node = np.zeros(len(columns), dtype=np.int64) if start is None else start.astype(np.int64)
    feature, cut = tree["feature"], tree["cut"]
    active = np.flatnonzero(feature[node] >= 0)
    while len(active):
        at = node[active]
        f = feature[at]
        absent = missing[active, f]
        left = np.where(absent, tree["default_left"][at], columns[active, f] <= cut[at])
        node[active] = np.where(left, tree["left"][at], tree["right"][at])
        active = active[feature[node[active]] >= 0]
    return node


def weighted_values(
    trees: Sequence[tuple[dict, float]], columns: np.ndarray, missing: np.ndarray, base: float | np.ndarray = 0.0
) -> np.ndarray:
    """``base`` and the trees' values, added in the order of the trees."""
    out = np.zeros(len(columns)) + base
    for tree, weight in trees:
        out += weight * tree["value"][leaf_of(tree, columns, missing)]
    return out


def cell_matrix(batch, column: str, width: int) -> np.ndarray:
    """A list column of an Arrow batch as (rows, features); null cells become NaN."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def gradients(margin: np.ndarray, y: np.ndarray, logistic: bool):
    """First and second derivative of the loss at the margin."""
    if not logistic:
        return margin - y, np.ones_like(y)
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _uniform(row_id: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number below 2^53 per row: a hash of seed, tree and row number, so any retry of a
    task draws the same."""
    with np.errstate(over="ignore"):
        h = row_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h += np.uint64((seed * 1_000_003 + tree) % 2**63)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(np.float64)


def sampled(row_id: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows drawn for a tree without replacement."""
    return _uniform(row_id, seed, tree) < share * 2.0**53


# Shares of rows drawn at most 0, 1, 2, … times when as many are drawn as there are.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def draws(row_id: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree with replacement (Poisson with mean 1)."""
    return np.searchsorted(_DRAWS, _uniform(row_id, seed, tree) / 2.0**53, side="right").astype(np.float64)


def drawn_fields(trees: int) -> str:
    return ", ".join(["code long", *[f"n{i} double, y{i} double" for i in range(trees)]])


def drawn_batch(code: np.ndarray, y: np.ndarray, *times: np.ndarray) -> pa.RecordBatch:
    """Rows drawn and their labels' sum per code, for each of some trees."""
    found, place = np.unique(code, return_inverse=True)
    sums = [np.bincount(place, weights, len(found)) for n in times for weights in (n, n * y)]
    names = [f"{c}{i}" for i in range(len(times)) for c in "ny"]
    return pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], names=["code", *names])


class GradientSums:
    """Sums of gradient, curvature and rows per (node, feature, bin). Slot 0 of a feature
    holds its missing values (bin -1)."""

    def __init__(self, nodes: Sequence[int], features: Sequence[int], bins: int, unit_curvature: bool = False):
        self.nodes, self.features, self.width = np.asarray(nodes), list(features), bins + 1
        # Squared error: every row's curvature is its weight, so one sum serves for both.
        self.unit = unit_curvature
        self.length = len(self.nodes) * self.width
        self.sums = np.zeros((len(self.features), 3, self.length))
        self.place = np.full(int(self.nodes.max(initial=0)) + 2, -1)
        self.place[self.nodes] = np.arange(len(self.nodes))

    def add(self, leaf: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray | None = None) -> None:
        local = self.place[np.minimum(leaf, len(self.place) - 1)]
        rows = np.flatnonzero(local >= 0)
        if not len(rows):
            return
        first, g = local[rows] * self.width + 1, g[rows]
        h = None if self.unit else h[rows]
        n = None if n is None else n[rows]
        columns = np.ascontiguousarray(bins[rows].T)
        for j, f in enumerate(self.features):
            slot = first + columns[f]
            for k, weights in ((0, g), (2, n), (1, h)):
                if k == 1 and h is None:
                    self.sums[j, 1] = self.sums[j, 2]
                elif len(slot) * 4 < self.length:
                    np.add.at(self.sums[j, k], slot, 1.0 if weights is None else weights)
                else:
                    self.sums[j, k] += np.bincount(slot, weights, self.length)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the node, feature and the (3, bins) sums of each node with any rows."""
        cells = self.sums.reshape(len(self.features), 3, len(self.nodes), self.width)
        seen = np.flatnonzero(cells[0, 2].sum(axis=1) > 0)
        node = np.repeat(seen, len(self.features))
        feature = np.tile(np.asarray(self.features), len(seen))
        found = cells[:, :, seen].transpose(2, 0, 1, 3).reshape(-1, 3, self.width)
        return node, feature, np.ascontiguousarray(found)


def gathered(parts: Iterable[tuple[np.ndarray, ...]], size: int = ROWS_PER_SUM) -> Iterator[tuple[np.ndarray, ...]]:
    """Row arrays of several batches put together, about ``size`` rows at a time."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= size:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, rows = [], 0
    if rows:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def best_cuts(cells: np.ndarray, l2: float, l1: float, min_weight: float, min_rows: float):
    """Best cut per node from summed cells (3, nodes, features, missing + bins).

    Returns gain, feature position, last bin on the left, whether missing values go left,
    and the left side's (g, h, rows); gain is -inf where no cut is allowed. Of equal gains
    the first feature and bin win, with missing values on the right."""
    known, missing = cells[..., 1:], cells[..., :1]
    total = cells.sum(axis=-1, keepdims=True)
    # Last axis: missing values on the right, on the left.
    left = np.stack([np.cumsum(known, axis=-1)] * 2, axis=-1)
    left[..., 1] += missing
    right = total[..., None] - left

    def strength(g, h):
        t = np.maximum(np.abs(g) - l1, 0.0)
        return np.divide(t * t, h + l2, out=np.zeros_like(g), where=h + l2 > 0)

    gain = strength(left[0], left[1]) + strength(right[0], right[1])
    gain -= strength(total[0], total[1])[..., None]
    allowed = np.ones(gain.shape, dtype=bool)
    for side in (left, right):
        allowed &= (side[2] > 0) & (side[2] >= min_rows) & (side[1] >= min_weight)
    allowed[..., 1] &= missing[2] > 0
    gain = np.where(allowed, gain, -np.inf).reshape(len(gain), -1)
    best = gain.argmax(axis=1)
    feature, bin_, goes_left = np.unravel_index(best, allowed.shape[1:])
    node = np.arange(len(gain))
    return gain[node, best], feature, bin_, goes_left, left[:, node, feature, bin_, goes_left].T


def added_up(key: np.ndarray, part: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their cells, added in the order of the parts."""
    order = np.lexsort((part, key))
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(cells[order], starts, axis=0) if len(key) else cells


SUMS = "pair int, feature int, part int, sums binary"
CUTS = (
    "node int, feature int, sums binary, gain double, cut double, default_left boolean, left_g double,"
    " left_h double, left_n double, g double, h double, n double"
)


def sums_batch(pair: np.ndarray, feature: np.ndarray, part: int, cells: np.ndarray) -> pa.RecordBatch:
    size = cells[0].nbytes if len(cells) else 0
    offsets = np.arange(len(cells) + 1, dtype=np.int32) * size
    data = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells))])
    numbers = [pa.array(c.astype(np.int32)) for c in (pair, feature, np.full(len(pair), part))]
    return pa.RecordBatch.from_arrays([*numbers, data], names=["pair", "feature", "part", "sums"])


def cells_of(column: pa.Array, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[np.frombuffer(b, np.float64) for b in column.to_pylist()]]).reshape(-1, 3, width)


def cuts_batch(node: np.ndarray, feature: np.ndarray, cells: np.ndarray, p: dict, keep: bool) -> pa.RecordBatch:
    """Best cut of each (node, feature), with its sums if they are kept."""
    gain, _, cut, default_left, left = best_cuts(
        cells.transpose(1, 0, 2)[:, :, None], p["lambda"], p["alpha"], p["min_child_weight"], p["min_rows"]
    )
    total = cells.sum(axis=2)
    sums = [c.tobytes() for c in cells] if keep else [None] * len(cells)
    arrays = [
        pa.array(node),
        pa.array(feature),
        pa.array(sums, pa.binary()),
        pa.array(np.where(np.isfinite(gain), gain, np.nan), from_pandas=True),
        pa.array(cut.astype(np.float64)),
        pa.array(default_left.astype(bool)),
        *[pa.array(np.ascontiguousarray(left[:, i])) for i in range(3)],
        *[pa.array(np.ascontiguousarray(total[:, i])) for i in range(3)],
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in CUTS.split(", ")])


# --- weighted quantile summaries -----------------------------------------------------------
#
# A summary is an array (4, entries): value, its own weight, and the least and greatest weight
# of all smaller values. Without pruning both are exact.


def summary_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The exact summary of values without missing ones."""
    value, place = np.unique(values, return_inverse=True)
    weight = np.bincount(place, weights, len(value))
    below = np.cumsum(weight) - weight
    return np.stack([value, weight, below, below])


def merged_summary(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two summaries, the one of all their values; the bounds add up."""
    if not a.shape[1] or not b.shape[1]:
        return a if a.shape[1] else b
    value = np.union1d(a[0], b[0])
    out = np.zeros((4, len(value)))
    out[0] = value
    for s in (a, b):
        total = s[3, -1] + s[1, -1]
        at = np.searchsorted(s[0], value)  # first entry not below the value
        here = at < s.shape[1]
        met = np.zeros(len(value), bool)
        met[here] = s[0, at[here]] == value[here]
        before = at > 0
        least, greatest = np.zeros(len(value)), np.full(len(value), total)
        least[before] = s[2, at[before] - 1] + s[1, at[before] - 1]
        greatest[here] = s[3, at[here]]
        out[1, met] += s[1, at[met]]
        out[2] += np.where(met, s[2, np.minimum(at, s.shape[1] - 1)], least)
        out[3] += greatest
    return out


def pruned_summary(s: np.ndarray, size: int) -> np.ndarray:
    """At most about ``size`` entries, evenly spaced by weight, ends included. Bounds widen by
    no more than the weight between neighbours; values of great weight stay."""
    if s.shape[1] <= size:
        return s
    total = s[3, -1] + s[1, -1]
    middle = (s[2] + s[3] + s[1]) / 2
    at = np.searchsorted(middle, total * np.arange(1, size) / size)
    heavy = np.flatnonzero(s[1] > 2 * total / size)
    kept = np.unique(np.concatenate([[0, s.shape[1] - 1], np.minimum(at, s.shape[1] - 1), heavy]))
    return s[:, kept]


def summary_cuts(s: np.ndarray, cuts: int) -> list[float]:
    """The values at which the weight of all values up to them first reaches 1, 2, … of
    ``cuts`` + 1 equal parts of the whole, without repeats and without the greatest value."""
    if not s.shape[1]:
        return []
    upto = (s[2] + s[3]) / 2 + s[1]
    goals = (s[3, -1] + s[1, -1]) * (np.arange(1, cuts + 1) / (cuts + 1))
    # Sums in another order must not move a goal that a value meets exactly.
    at = np.searchsorted(upto * (1 + 1e-9), goals)
    found = np.unique(s[0, np.minimum(at, s.shape[1] - 1)])
    return [float(v) for v in found if v < s[0, -1]]


class Summaries:
    """Weighted summaries of several features, fed in batches: batches merge like the digits
    of a binary counter, so an entry is pruned only log(batches) times."""

    def __init__(self, features: int, size: int):
        self.size = size
        self.levels: list[list[np.ndarray | None]] = [[] for _ in range(features)]

    def add(self, columns: np.ndarray, weights: np.ndarray) -> None:
        for f, levels in enumerate(self.levels):
            x = columns[:, f]
            known = ~np.isnan(x)
            self._carry(levels, pruned_summary(summary_of(x[known], weights[known]), self.size))

    def _carry(self, levels: list, s: np.ndarray) -> None:
        for i, held in enumerate(levels):
            if held is None:
                levels[i] = s
                return
            s, levels[i] = pruned_summary(merged_summary(held, s), self.size), None
        levels.append(s)

    def result(self, feature: int) -> np.ndarray:
        out = np.zeros((4, 0))
        for s in self.levels[feature]:
            if s is not None:
                out = merged_summary(out, s)
        return pruned_summary(out, self.size)
