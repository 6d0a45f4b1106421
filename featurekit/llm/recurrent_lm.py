"""A gated recurrent language model with a class-factored output softmax, in numpy.

The head of the training texts' words forms classes of equal size, about as many as a class
has words, so that both grow with the root of the head. One more class holds all other words
(and another those of the head that a smaller layout of classes leaves out). A word's
probability is its class's, given the state, times its own within the class: a softmax for
the head, smoothed counts for the others. The softmax of the classes, and that of the first class,
which holds about a third of the tokens, goes in two steps: a group of places, then the place. Training is truncated backpropagation through windows that carry
the state on, by tasks that start from the same weights and whose results are averaged.
Scoring carries the state through a whole document.

Counts come from all training texts. The words that have most of the occurrences are sent
to the tasks (``HEAD`` of them at most); the others meet their counts in a shuffle join.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurekit.llm.tables import written
from featurekit.llm.words import slices, words

#: The layout of a vocabulary that is given none (:func:`layout` has that of a whole head).
CLASS_SIZE, CLASSES = 64, 32
HEAD = 100_000
HIDDEN = 24
#: Training: lanes of text side by side at most, steps of a window, rate, passes of averaging,
#: and the share of the training texts that a pass goes through (each pass takes others).
LANES, WINDOW, RATE = 512, 24, 0.08
#: Tokens of a lane at least: a small group of texts takes fewer lanes, and more windows.
STRETCH = 1200
PASSES, SHARE = 1, 1
#: Bytes of text that are dealt to the lanes together.
TRAIN_BYTES = 4 << 20
#: Tokens of a training task on average at least: each task hands on a change of all weights.
TASK_TOKENS = 4_000_000
#: Numbers of a piece of the weights, as they are summed and sent to the driver.
PIECE = 1 << 20
#: Scoring: lanes, steps of a window, and bytes of text that are scored together.
SCORE_LANES, SCORE_WINDOW, SCORE_BYTES = 256, 64, 8 << 20
#: Tokens at least, short of the last, whose probabilities are looked up together, class by class.
SCORE_TOKENS = 1 << 16

END = np.uint64(0xE0D0F7E87)
#: Added to counts, and once more for all unknown words together.
SMOOTH = 0.1

MIDDLE, RARE = CLASS_SIZE * CLASSES, CLASS_SIZE * CLASSES + 1


def with_end(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end, and n + 1 borders."""
    hashed, first = words(batch.column("text"))
    return np.insert(hashed, first[1:], END), first + np.arange(len(first))


def token_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) of all tokens of the texts: summed per slice, per task, then overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in slices(batches):
            waiting.append(with_end(batch)[0])
            if sum(map(len, waiting)) > 2_000_000:
                yield summed()
        if waiting:
            yield summed()

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, falling, ``head`` at most.

    The words are chosen by classes of their count's logarithm (some thousand classes at
    most), so that no more than ``head`` rows are ever sent to the driver, from however
    many tasks; words of the class that would pass ``head`` stay out.
    """
    leveled = counts.withColumn("level", F.floor(F.log2("n") * 64).cast("int"))
    least, taken = None, 0
    for row in sorted(leveled.groupBy("level").count().collect(), reverse=True):
        taken += row["count"]
        if taken > head:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = leveled.where(F.col("level") >= least).select("hash", "n").toPandas()
    top = top.sort_values(["n", "hash"], ascending=[False, True])
    return top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)


def layout(words: int) -> tuple[int, int]:
    """Classes and their size, for a softmax over all ``words`` of a head."""
    size = max(1, math.isqrt(max(words - 1, 0)) + 1)
    return max(1, -(-words // size)), size


class Vocabulary:
    """The head of the counts: hashes sorted, their counts and ranks; totals of all words.
    The first classes x size words of the head have a softmax."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, classes: int = CLASSES, size: int = CLASS_SIZE):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.ranks = hashes[order], counts[order], order.astype(np.int64)
        self.total, self.distinct = total, distinct
        self.middle = classes * size  # the id of the head's other words; unknown words come next
        frequent = min(self.middle, len(hashes))
        by_rank = np.zeros(self.middle)
        by_rank[:frequent] = counts[:frequent]
        self.frequent = by_rank.reshape(classes, size)
        self.middle_total = float(counts[frequent:].sum()) + SMOOTH * max(len(hashes) - frequent, 1)
        rare, kinds = total - int(counts.sum()), distinct - len(hashes)
        self.rare_total = rare + SMOOTH * (kinds + 1)
        self.class_counts = np.r_[self.frequent.sum(axis=1), counts[frequent:].sum(), rare + SMOOTH]
        self.base_total = total + SMOOTH * (distinct + 1)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head (any place for others) and whether the token is there."""
        if not len(self.hashes):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        place = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return place, self.hashes[place] == tokens

    def ids(self, place: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Model ids: the rank of words in classes, else ``middle`` or the id after it."""
        if not len(self.hashes):
            return np.full(len(place), self.middle + 1, np.int32)
        return np.where(known, np.minimum(self.ranks[place], self.middle), self.middle + 1).astype(np.int32)

    def end_id(self) -> int:
        return int(self.ids(*self.find(np.array([END])))[0])


def shapes(classes: int, size: int) -> dict[str, tuple[int, ...]]:
    return {
        "input": (classes * size + 2, 3 * HIDDEN),
        "gates": (HIDDEN, 2 * HIDDEN),
        "state": (HIDDEN, HIDDEN),
        "classes": (HIDDEN, classes + 2),
        "class_bias": (classes + 2,),
        "members": (classes, HIDDEN, size),
        "member_bias": (classes, size),
    }


def pack_weights(weights: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([weights[k].ravel() for k in shapes(1, 1)], dtype="<f4").tobytes()


def unpack_weights(data: bytes, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k, shape in shapes(*vocabulary.frequent.shape).items():
        n = math.prod(shape)
        out[k] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


def first_weights(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights, and biases that give the counts' own distribution."""
    rng = np.random.default_rng(7)
    out = {k: rng.standard_normal(s, np.float32) * np.float32(0.1) for k, s in shapes(*vocabulary.frequent.shape).items()}
    out["members"] *= 0.1
    out["class_bias"] = _two_step_bias(vocabulary.class_counts + 0.5).astype(np.float32)
    member = vocabulary.frequent + SMOOTH
    member.ravel()[len(vocabulary.hashes) :] = 1e-9  # no words: the last class may not be full
    bias = np.log(member / member.sum(axis=1, keepdims=True))
    bias[0] = _two_step_bias(member[0])
    out["member_bias"] = bias.astype(np.float32)
    return out


# A softmax over K places in two steps takes a weight column per place, like a plain one: that of
# a group's first place is the group's logit, and the first place's own, inside its group, is 0.


def _group_size(places: int) -> int:
    return math.isqrt(max(places - 1, 0)) + 1


def _two_step_bias(share: np.ndarray) -> np.ndarray:
    size = _group_size(len(share))
    heads = np.arange(0, len(share), size)
    out = np.log(share / share[heads].repeat(size)[: len(share)])
    out[heads] = np.log(np.add.reduceat(share, heads) / share.sum())
    return out


def _exps(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, pinned: bool = False, at: np.ndarray | None = None) -> tuple:
    """exp of the rows' logits, their sums, and the logits at ``at``. ``pinned``: one place more,
    before the others, has the logit 0. Rows are shifted by their greatest logit only where
    exp would leave the range of floats."""
    x = states @ weights
    x += bias
    own = None
    if at is not None:
        own = np.where(at < 0, 0, x[np.arange(len(x)), at]) if pinned else x[np.arange(len(x)), at]
    ones = np.ones(x.shape[1], x.dtype)
    total = np.exp(x, out=x) @ ones
    if pinned:
        total += 1
    if not (total.min() > 1e-20 and total.max() < 1e30):
        x = states @ weights + bias
        top = x.max(axis=1)
        if pinned:
            top = np.maximum(top, 0)
        x -= top[:, None]
        total = np.exp(x, out=x) @ ones
        if pinned:
            total += np.exp(-top)
        if own is not None:
            own = own - top
    return x, total, own


def _groups_of(places: int, at: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Columns of each group but its first, and the rows (sorted by place) that are in the group."""
    size = _group_size(places)
    ends = np.searchsorted(at, np.arange(0, places + size, size))
    for g in range(len(ends) - 1):
        columns = slice(g * size + 1, min(g * size + size, places))
        if ends[g] < ends[g + 1] and columns.start < columns.stop:
            yield columns, slice(ends[g], ends[g + 1])


def _log_share(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of one place of each row."""
    _, total, own = _exps(states, weights, bias, at=at)
    return own - np.log(total)


def _two_step_log_share(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same in two steps; rows are sorted by place."""
    size = _group_size(weights.shape[1])
    out = _log_share(states, weights[:, ::size], bias[::size], at // size)
    for columns, rows in _groups_of(weights.shape[1], at):
        _, total, own = _exps(states[rows], weights[:, columns], bias[columns], True, at[rows] - columns.start)
        out[rows] += own - np.log(total)
    return out


def _gradient(states: np.ndarray, scaled: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray, pinned: bool = False) -> tuple:
    """Of the summed -log softmax: by states (to be scaled), by weights and by bias; ``scaled`` are
    the states times the scale."""
    found, total, _ = _exps(states, weights, bias, pinned)
    if pinned:
        inner = np.flatnonzero(at >= 0)
        found[inner, at[inner]] -= total[inner]
    else:
        found[np.arange(len(at)), at] -= total
    inverse = 1 / total  # found are the softmax's gradients times total
    by_states = found @ weights.T
    by_states *= inverse[:, None]
    return by_states, (scaled * inverse[:, None]).T @ found, inverse @ found


def _two_step_gradient(states: np.ndarray, scaled: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple:
    """The same in two steps; rows are sorted by place."""
    size = _group_size(weights.shape[1])
    by_weights, by_bias = np.zeros_like(weights), np.zeros_like(bias)
    out, by_weights[:, ::size], by_bias[::size] = _gradient(states, scaled, weights[:, ::size], bias[::size], at // size)
    for columns, rows in _groups_of(weights.shape[1], at):
        found = _gradient(states[rows], scaled[rows], weights[:, columns], bias[columns], at[rows] - columns.start, True)
        out[rows] += found[0]
        by_weights[:, columns], by_bias[columns] = found[1:]
    return out, by_weights, by_bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of x."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def lanes_of(ids: np.ndarray, borders: np.ndarray, lanes: int, end_id: int) -> tuple[np.ndarray, ...]:
    """Documents side by side: (inputs, targets, fresh, place), each steps x lanes, with the
    fullest lanes first. fresh: a document starts; place: the token's place in ids, -1 for
    none. Longest documents are dealt first, each to the emptiest lane. Beside one very
    long document fewer lanes are opened, so that the table stays within four times the
    tokens."""
    sizes = np.diff(borders)
    room = 4 * len(ids) // int(sizes.max()) if len(sizes) else 1
    lanes = max(1, min(lanes, len(sizes), room))
    heap, dealt = [(0, j) for j in range(lanes)], [[] for _ in range(lanes)]
    for doc in np.argsort(-sizes, kind="stable"):
        filled, j = heapq.heappop(heap)
        dealt[j].append(doc)
        heapq.heappush(heap, (filled + int(sizes[doc]), j))
    dealt.sort(key=lambda docs: -int(sizes[docs].sum()))
    steps = int(sizes[dealt[0]].sum()) if len(sizes) else 0
    place = np.full((steps, lanes), -1, np.int64)
    fresh = np.zeros((steps, lanes), bool)
    for j, docs in enumerate(dealt):
        at = 0
        for doc in docs:
            place[at : at + sizes[doc], j] = np.arange(borders[doc], borders[doc + 1])
            fresh[at, j] = True
            at += int(sizes[doc])
    before = np.r_[end_id, ids[:-1]] if len(ids) else ids
    inputs = np.where(fresh, end_id, before[place])
    return inputs, ids[place], fresh, place


def stretches_of(ids: np.ndarray, borders: np.ndarray, end_id: int) -> tuple[np.ndarray, ...]:
    """All tokens in equal stretches side by side, as :func:`lanes_of` has documents: each token
    once, and only the last stretch may be shorter."""
    n = len(ids)
    lanes = max(1, min(LANES, n // STRETCH))
    place = np.arange(lanes * -(-n // lanes)).reshape(lanes, -1).T
    starts = np.zeros(place.size, bool)
    starts[borders[:-1]] = True
    inner = np.minimum(place, n - 1)
    before = np.r_[end_id, ids[:-1]] if n else ids
    fresh = starts[place]
    return np.where(fresh, end_id, before[inner]), ids[inner], fresh, np.where(place < n, place, -1)


def _forward(w: dict, h: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step of a window, and the last one. A step's numbers lie lane by lane."""
    gates = np.ascontiguousarray(w["input"][inputs].transpose(0, 2, 1))
    out = np.empty((len(inputs), HIDDEN, inputs.shape[1]), np.float32)
    h = np.ascontiguousarray(h.T)
    for t in range(len(inputs)):
        if fresh[t].any():
            h = h * ~fresh[t]
        rz = w["gates"].T @ h
        rz += gates[t, : 2 * HIDDEN]
        r, z = _sigmoid(rz)[:HIDDEN], rz[HIDDEN:]
        n = w["state"].T @ (r * h)
        n += gates[t, 2 * HIDDEN :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((h, rz, n))
        np.subtract(n, h, out=out[t])
        out[t] *= z
        out[t] += h
        h = out[t]
    return out.transpose(0, 2, 1), h.T


def _classes(w: dict, sorted_targets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The rows of each class that has a softmax."""
    n, _, size = w["members"].shape
    ends = np.searchsorted(sorted_targets, np.arange(0, (n + 1) * size, size))
    for c in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        yield c, slice(ends[c], ends[c + 1])


def class_of(w: dict, targets: np.ndarray) -> np.ndarray:
    n, _, size = w["members"].shape
    return np.where(targets < n * size, targets // size, n + (targets > n * size))


def log_probability(w: dict, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target's class and, in a frequent class, of the word."""
    order = np.argsort(targets, kind="stable")
    states, targets = states[order], targets[order]
    out = np.empty(len(targets))
    with np.errstate(over="ignore"):
        found = _two_step_log_share(states, w["classes"], w["class_bias"], class_of(w, targets)).astype(np.float64)
        for c, rows in _classes(w, targets):
            share = _log_share if c else _two_step_log_share
            found[rows] += share(states[rows], w["members"][c], w["member_bias"][c], targets[rows] - c * w["members"].shape[2])
    out[order] = found
    return out


#: Classes whose weights are changed together.
CLASS_BLOCK = 8


class Trainer:
    """Adagrad on windows of truncated backpropagation. The members' weights and biases lie in one
    array, a class after another, and so do their gradients."""

    def __init__(self, weights: dict[str, np.ndarray]):
        members = np.concatenate([weights["members"], weights["member_bias"][:, None]], axis=1)
        self.members, self.by_members = members, np.zeros_like(members)
        self.w = {**weights, "members": members[:, :HIDDEN], "member_bias": members[:, HIDDEN]}
        self.squares = {k: np.full(v.shape, 1e-4, np.float32) for k, v in weights.items()}

    def _apply(self, name: str, g: np.ndarray, at=...) -> None:
        squares = self.squares[name][at]
        squares += g * g
        if isinstance(at, np.ndarray):  # squares are a copy, no view
            self.squares[name][at] = squares
        step = np.sqrt(squares)
        np.divide(g, step, out=step)
        step *= np.float32(RATE)
        self.w[name][at] -= step

    def window(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, real: np.ndarray) -> np.ndarray:
        w, kept = self.w, []
        states, after = _forward(w, h, inputs, fresh, kept)
        places = np.flatnonzero(real)
        want = targets.ravel()[places]
        order = np.argsort(want, kind="stable")
        places, want = places[order], want[order]
        steps, lane = np.divmod(places, inputs.shape[1])
        flat = states[steps, lane]
        scale = np.float32(1 / inputs.shape[1])
        scaled = flat * scale
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            d_flat, by_weights, by_bias = _two_step_gradient(flat, scaled, w["classes"], w["class_bias"], class_of(w, want))
            more, total = self._learn_members(flat, scale, want, False)
            if len(total) and not (total.min() > 1e-20 and total.max() < 1e30):
                more, total = self._learn_members(flat, scale, want, True)
        d_flat[: len(more)] += more
        for c in range(0, len(self.members), CLASS_BLOCK):
            block = slice(c, c + CLASS_BLOCK)
            self._apply("members", self.by_members[block, :HIDDEN], block)
            self._apply("member_bias", self.by_members[block, HIDDEN], block)
        self._apply("classes", by_weights)
        self._apply("class_bias", by_bias * scale)

        d_flat *= scale
        d_states = np.zeros((inputs.size, HIDDEN), np.float32)
        d_states[places] = d_flat
        d_states = np.ascontiguousarray(d_states.reshape(*inputs.shape, HIDDEN).transpose(0, 2, 1))
        d_gates = np.zeros((len(inputs), 3 * HIDDEN, inputs.shape[1]), np.float32)
        d_u, d_s = np.zeros_like(w["gates"]), np.zeros_like(w["state"])
        d_h = np.zeros_like(d_states[0])
        for t in range(len(inputs) - 1, -1, -1):
            before, rz, n = kept[t]
            r, z = rz[:HIDDEN], rz[HIDDEN:]
            d_h = d_h + d_states[t]
            d_rz, d_n = d_gates[t, : 2 * HIDDEN], d_gates[t, 2 * HIDDEN :]
            np.multiply(d_h * z, 1 - n * n, out=d_n)
            d_rh = w["state"] @ d_n
            np.multiply(d_rh, before, out=d_rz[:HIDDEN])
            np.multiply(d_h, n - before, out=d_rz[HIDDEN:])
            d_rz *= rz * (1 - rz)
            d_s += (r * before) @ d_n.T
            d_u += before @ d_rz.T
            d_h *= 1 - z
            d_h += d_rh * r
            d_h += w["gates"] @ d_rz
            if fresh[t].any():
                d_h *= ~fresh[t]
        self._apply("gates", np.clip(d_u, -1, 1))
        self._apply("state", np.clip(d_s, -1, 1))
        used = inputs.ravel()
        order = np.argsort(used, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(used[order]) > 0])
        rows = d_gates.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
        summed = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
        self._apply("input", np.clip(summed, -1, 1, out=summed), used[order][first])
        return after

    def _learn_members(self, flat: np.ndarray, scale: np.float32, want: np.ndarray, shifted: bool) -> tuple[np.ndarray, np.ndarray]:
        """Fills the gradients by the members' weights; those by the states (to be scaled), and the
        sums of exp, for the first of the sorted rows: all whose class has a softmax. ``shifted``:
        by each row's greatest logit, for sums beyond the range of floats."""
        w, size = self.w, self.members.shape[2]
        n = int(np.searchsorted(want, len(self.members) * size))
        local, index, ones = want[:n] % size, np.arange(n), np.ones(size, flat.dtype)
        with_one = np.concatenate([flat[:n], np.ones((n, 1), flat.dtype)], axis=1)
        scaled = with_one * scale
        out, totals = np.empty((n, HIDDEN), flat.dtype), np.ones(n, flat.dtype)
        touched = np.zeros(len(self.members), bool)
        for c, rows in _classes(w, want):
            touched[c] = True
            by = self.by_members[c]
            if c == 0:
                out[rows], by[:HIDDEN], by[HIDDEN] = _two_step_gradient(flat[rows], scaled[rows, :HIDDEN], w["members"][0], w["member_bias"][0], local[rows])
                by[HIDDEN] *= scale
                continue
            x = with_one[rows] @ self.members[c]
            if shifted:
                x -= x.max(axis=1)[:, None]
            np.exp(x, out=x)
            total = np.matmul(x, ones, out=totals[rows])
            x[index[: len(x)], local[rows]] -= total  # the softmax's gradients times total
            np.matmul(x, w["members"][c].T, out=out[rows])
            np.matmul((scaled[rows] / total[:, None]).T, x, out=by)
        self.by_members[~touched] = 0
        out /= totals[:, None]
        return out, totals

    def learn(self, ids: np.ndarray, borders: np.ndarray, end_id: int) -> None:
        """One step per window of all texts. Lanes are equally long, so every step rests on all of
        them: a long text goes on in the next lane, from an empty state there."""
        inputs, targets, fresh, place = stretches_of(ids, borders, end_id)
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for at in range(0, len(inputs), WINDOW):
            cut = slice(at, at + WINDOW)
            h = self.window(h, inputs[cut], targets[cut], fresh[cut], place[cut] >= 0)


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    waiting, held = [], 0
    for batch in slices(batches):
        waiting.append(batch)
        held += batch.nbytes
        if held >= size:
            yield waiting
            waiting, held = [], 0
    if waiting:
        yield waiting


_PIECES = "piece int, weights binary, n long"


def _pieces(flat: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(flat), PIECE):
        yield _piece(i // PIECE, flat[i : i + PIECE], n)


def _piece(i: int, part: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype("<f4").tobytes()], pa.binary()), pa.array([n])], names=["piece", "weights", "n"])


def _mean(rows: DataFrame, n: int) -> bytes | None:
    """The mean of weights in pieces, by their n; summed in two levels, in streams. The
    driver takes one piece after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for i, data, k in zip(*(batch.column(c).to_pylist() for c in ("piece", "weights", "n")), strict=True):
                part = np.frombuffer(data, "<f4").astype(np.float64) * k
                sums[i] = (sums[i][0] + part, sums[i][1] + k) if i in sums else (part, k)
        for i, (part, k) in sums.items():
            yield _piece(i, part / k, k)

    each = max(1, math.isqrt(n))
    rows = rows.repartition(each).mapInArrow(run, _PIECES)
    rows = rows.repartition(each, "piece").mapInArrow(run, _PIECES)
    found = {row["piece"]: bytes(row["weights"]) for row in rows.toLocalIterator()}
    return b"".join(found[i] for i in sorted(found)) or None


def train(texts: DataFrame, vocabulary: Vocabulary, passes: int = PASSES, share: float = SHARE) -> dict[str, np.ndarray]:
    """Weights from (doc_id, text). Each pass goes through its own ``share`` of the texts, by a
    hash of doc_id, so that the work grows with the table; a task learns from its texts in
    lanes, and the mean of all tasks' changes of the weights, by their tokens, starts the next
    pass. Small tables take few tasks, as a change is as large as the weights."""
    spark = texts.sparkSession
    weights = pack_weights(first_weights(vocabulary))
    vocabulary_sent = spark.sparkContext.broadcast(vocabulary)  # HEAD words at most
    parts = round(1 / share)
    for i in range(min(passes, parts)):
        chosen = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == i)
        tasks = max(1, int(vocabulary.total * share) // TASK_TOKENS)
        chosen = chosen.coalesce(tasks)
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = vocabulary_sent.value
            trainer = Trainer(unpack_weights(sent.value, known))
            seen, end_id = 0, known.end_id()
            for group in _groups(batches, TRAIN_BYTES):
                token, borders = with_end(pa.Table.from_batches(group).combine_chunks().to_batches()[0])
                trainer.learn(known.ids(*known.find(token)), borders, end_id)
                seen += len(token)
            if seen:
                change = np.frombuffer(pack_weights(trainer.w), "<f4") - np.frombuffer(sent.value, "<f4")
                yield from _pieces(change, seen)

        change = _mean(chosen.mapInArrow(run, _PIECES), tasks)  # kept by its shuffle only
        if change:
            weights = (np.frombuffer(weights, "<f4") + np.frombuffer(change, "<f4")).tobytes()
        sent.destroy()
    return unpack_weights(weights, vocabulary)


_SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>, rare_n array<long>"


def _head_scores(docs: DataFrame, vocabulary: Vocabulary, weights: dict[str, np.ndarray]) -> DataFrame:
    """Sums over the tokens of each row whose word is in the head, the classes' part of all
    tokens, and the other words with their numbers in the text."""
    context = docs.sparkSession.sparkContext
    sent, sent_weights = context.broadcast(vocabulary), context.broadcast(pack_weights(weights))

    def score(group: list[pa.RecordBatch], known: Vocabulary, w: dict) -> pa.RecordBatch:
        batch = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
        token, borders = with_end(batch)
        place, there = known.find(token)
        ids = known.ids(place, there)
        count = known.counts[place] if len(known.counts) else np.zeros(len(place))
        base = np.where(there, np.log10((count + SMOOTH) / known.base_total), 0.0)
        model = np.where(ids == known.middle, np.log10((count + SMOOTH) / known.middle_total), 0.0)
        inputs, targets, fresh, at = lanes_of(ids, borders, SCORE_LANES, known.end_id())
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        waiting: list[tuple[np.ndarray, ...]] = []
        for step in range(0, len(inputs), SCORE_WINDOW):
            cut = slice(step, step + SCORE_WINDOW)
            n = int((at[step] >= 0).sum())
            real = at[cut, :n] >= 0
            states, h = _forward(w, h[:n], inputs[cut, :n], fresh[cut, :n])
            waiting.append((states[real], targets[cut, :n][real], at[cut, :n][real]))
            if step + SCORE_WINDOW >= len(inputs) or sum(len(x) for x, _, _ in waiting) >= SCORE_TOKENS:
                states, wanted, places = (np.concatenate(x) for x in zip(*waiting, strict=True))
                model[places] += log_probability(w, states, wanted) / math.log(10)
                waiting.clear()

        def sums(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, borders[:-1])  # every text has its end

        rest = np.flatnonzero(~there)
        doc = np.searchsorted(borders, rest, "right") - 1
        order = np.lexsort((token[rest], doc))
        doc, rare = doc[order], token[rest][order]
        first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (rare[1:] != rare[:-1])]) if len(rare) else np.zeros(0, int)
        ends = np.searchsorted(doc[first], np.arange(batch.num_rows + 1)).astype(np.int32)
        each = np.diff(np.r_[first, len(rare)])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(borders)), pa.array(sums(there.astype(np.int64))),
                pa.array(sums(base)), pa.array(sums(model)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(rare[first].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(each)),
            ],
            names=[f.split()[0] for f in _SCORED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = sent.value, unpack_weights(sent_weights.value, sent.value)
        for group in _groups(batches, SCORE_BYTES):
            yield score(group, known, w)

    return docs.mapInArrow(run, _SCORED)


def score_texts(docs: DataFrame, folds: int = 10, head: int = HEAD, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row.

    Learns from the texts whose crc32(doc_id as text) modulo ``folds`` is not 0; the others
    are held out. Tokens are words (anything but white space, A-Z lower-cased) and an end.
    base_score sums log10 of smoothed word shares, score is the model's log10 probability
    of the text. Null texts are empty: their only token is the end. Rows without doc_id are
    scored, but neither learnt from nor held out; repeated rows are rows. Without
    training texts every token is unknown. A text is scored whole, in one task.
    """
    learn = F.crc32(F.col(f"`{doc_id}`").cast("string")) % folds
    read = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(learn == 0, F.lit(False)).alias("held_out"),
        F.coalesce(learn != 0, F.lit(False)).alias("_learn"), F.col(f"`{text}`").alias("text"),
    )
    texts = read.where("_learn").select("doc_id", "text")
    counts = written(token_counts(texts))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = totals["n"] or 0, totals["v"]
    hashes, n = most_frequent(counts, head)
    vocabulary = Vocabulary(hashes, n, total, distinct, *layout(len(hashes)))
    weights = train(texts, vocabulary)

    rows = written(_head_scores(read.select("doc_id", "held_out", "text"), vocabulary, weights).withColumn("_row", F.monotonically_increasing_id()))
    others = rows.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x"))
    others = others.select("_row", F.col("x.rare").alias("hash"), F.col("x.rare_n").alias("k"))
    count = F.coalesce("n", F.lit(0)) + SMOOTH
    found = others.join(counts, "hash", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("_known"),
        F.sum(F.col("k") * F.log10(count / vocabulary.base_total)).alias("_base"),
        F.sum(F.col("k") * F.log10(count / vocabulary.rare_total)).alias("_model"),
    )

    def plus(column: str, more: str):
        return F.col(column) + F.coalesce(more, F.lit(0))

    return rows.join(found, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "_base").alias("base_score"), plus("model", "_model").alias("score"),
    )
