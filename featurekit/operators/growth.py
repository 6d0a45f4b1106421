"""The written training table of boosted trees, and the search for the best cuts in it.

Rows carry their label, margin and, in deep trees, the node they have reached, so no task
walks earlier trees or a deep tree from its root. Three ways to search, one scan of the rows
per level each; the driver sees one row per node. Where bins can differ in fewer ways than half
the number of rows, ``hist`` keeps one row per combination of bins, with its number of rows and
their mean label: rows of equal bins share every node and margin, and gradients are linear in the
label, so all sums stay the same.

``hist``
    Tasks sum gradients per (node, feature, bin). In tables whose scan is dear, only the smaller
    of two siblings is summed; the other one is the parent's sums, kept as a table, minus these.
    Each feature's best cut is found where its sums are added up.
``approx``
    The same, with cuts proposed anew before each tree: quantiles weighted by curvature, from
    mergeable summaries.
``exact``
    Every distinct value is a cut. Values are summed per (node, feature, value), values are cut
    into ranges with literal bounds, range totals are scanned per node and feature, and each
    range is scanned by itself from its total on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trees as tree_functions
from ..functions.bins import distinct_edges, equal_frequency_probs, with_bin_number
from ..functions.quantiles import column_chunks, exact_quantiles
from ..functions.trees import (
    CUTS,
    SUMS,
    GradientSums,
    Summaries,
    added_up,
    cell_matrix,
    cells_of,
    cuts_batch,
    drawn_batch,
    drawn_fields,
    draws,
    gathered,
    gradients,
    leaf_of,
    merged_summary,
    pruned_summary,
    sampled,
    summary_cuts,
    sums_batch,
    weighted_values,
)
from ..schema import as_double
from ..session import remove_folder, shared_folder

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(tree_functions)

# Histogram cells one task keeps at a time; more nodes take more scans.
CELLS_PER_JOB = 8_000_000
# Steps down a tree after which rows keep the node they have reached.
LEVELS_PER_TABLE = 8
# Tables of fewer rows are dealt to all cores, this many rows each at least.
SMALL_ROWS, ROWS_PER_TASK = 4_000_000, 20_000
# Tasks per core that scan the table: each hands on sums of all nodes it has met.
TASKS_PER_CORE = 4
# Cells (rows times features) from which on a scan costs more than keeping its sums as a table.
KEEP_CELLS = 200_000_000
# Rows per possible combination of bins from which on equal rows are put together.
ROWS_PER_GROUP = 2
# Rows whose draws are put together at a time, and trees that share the scan of the rows.
DRAWS_PER_SUM, TREES_PER_DRAW = 1 << 20, 4
# Bytes of sums that one task adds up.
BYTES_PER_PARTITION = 32 << 20
# Entries of a weighted summary per cut, and summaries that one task merges.
SUMMARY_ENTRIES, FAN_IN = 32, 64
MIN_GAIN = 1e-6

class Growth:
    """A tree while it grows: nodes, their sums (g, h, rows) and the best known split of each."""

    def __init__(self):
        self.sums: list[tuple[float, float, float]] = []
        self.depth: list[int] = []
        self.split: list[dict | None] = []
        self.parent: list[int] = []
        self.children: dict[int, tuple[int, int]] = {}
        self._new((0.0, 0.0, 0.0), 0, -1)

    def _new(self, sums: tuple[float, float, float], depth: int, parent: int) -> int:
        self.sums.append(sums)
        self.depth.append(depth)
        self.split.append(None)
        self.parent.append(parent)
        return len(self.sums) - 1

    def expand(self, node: int) -> tuple[int, int]:
        if node not in self.children:
            s, depth = self.split[node], self.depth[node] + 1
            self.children[node] = (self._new(s["left"], depth, node), self._new(s["right"], depth, node))
        return self.children[node]

    def arrays(self, internal: set[int] | None = None, value=None) -> dict:
        """Node arrays; ``internal`` limits the splits used, value(node) fills leaves."""
        inner = set(self.children) if internal is None else internal
        n = len(self.sums)
        out = {
            "feature": np.full(n, -1),
            "cut": np.zeros(n),
            "default_left": np.zeros(n, dtype=bool),
            "left": np.zeros(n, dtype=np.int64),
            "right": np.zeros(n, dtype=np.int64),
            "value": np.zeros(n),
        }
        for node in inner:
            s = self.split[node]
            out["feature"][node], out["cut"][node] = s["feature"], s["cut"]
            out["default_left"][node] = s["default_left"]
            out["left"][node], out["right"][node] = self.children[node]
        if value is None:
            return out
        # Keep reachable nodes only, numbered anew from the root.
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            if node in inner:
                stack += reversed(self.children[node])
            else:
                out["value"][node] = value(node)
        number = np.zeros(n, dtype=np.int64)
        number[order] = np.arange(len(order))
        compact = {name: a[order] for name, a in out.items()}
        for side in ("left", "right"):
            compact[side] = np.where(compact["feature"] >= 0, number[compact[side]], -1)
        return compact


class TrainingTable:
    """Rows (row, y, margin, node, cells …) in the shared folder, rewritten as trees grow."""

    #: The column that trees are walked on: bin numbers or values.
    cells = "bins"
    #: Whether a row stands for ``weight`` rows of equal bins, with their mean label.
    grouped = False

    def __init__(self, df: DataFrame, features: Sequence[str], y: Column, base: float, logistic: bool, p: dict, rows: int):
        self.features, self.logistic, self.p = list(features), logistic, p
        self.spark = df.sparkSession
        self.rows = rows
        self.cores = self.spark.sparkContext.defaultParallelism
        self.tasks = max(64, TASKS_PER_CORE * self.cores)
        self.folder, self.step, self.at = shared_folder(self.spark), 0, None
        self.stored_for = -1  # the tree whose nodes the rows carry
        self.steps = 0
        self.kept: dict[int, DataFrame] = {}  # node -> table with its sums
        self.passed: list[str] = []  # folders that go when the next tree is begun
        # Columns at f0, f1, …: the table's own names cannot clash.
        values = df.select(y.alias("y"), *[as_double(df, f).alias(f"f{i}") for i, f in enumerate(features)])
        binned = self.start(df, values)
        if self.rows < SMALL_ROWS:
            # Groups go by their key: their means may differ in the last bit when a task runs again.
            keys = ["code"] if self.grouped else []
            binned = binned.repartition(max(1, min(self.cores, -(-self.rows // ROWS_PER_TASK))), *keys)
        self.rewrite(
            binned.select(
                F.monotonically_increasing_id().alias("row"), "y", F.lit(float(base)).alias("margin"),
                F.lit(0).alias("node"), *[c for c in binned.columns if c != "y"],
            )
        )

    def start(self, df: DataFrame, values: DataFrame) -> DataFrame:
        """The columns y, and those that the search needs, from y, f0, f1, …"""
        raise NotImplementedError

    # --- tables ----------------------------------------------------------------------------

    def rewrite(self, table: DataFrame) -> None:
        """The older table goes when the next tree is begun."""
        if self.at:
            self.passed.append(self.at)
        self.at = f"{self.folder}/step-{self.step}"
        self.step += 1
        table.write.parquet(self.at)
        self.table = self.spark.read.schema(table.schema).parquet(self.at).coalesce(self.tasks)

    def close(self) -> None:
        remove_folder(self.spark, self.folder)

    # --- rows ------------------------------------------------------------------------------

    def reader(self, pending: Sequence[tuple[dict, float]] = (), tree_no: int = -1):
        """batch -> (cells, missing, margin with the pending trees, node reached so far)."""
        name, width, stored = self.cells, len(self.features), tree_no >= 0 and tree_no == self.stored_for
        pending = list(pending)

        def read(batch):
            x = cell_matrix(batch, name, width)
            missing = np.isnan(x) if x.dtype.kind == "f" else x < 0
            margin = batch.column("margin").to_numpy()
            if pending:
                margin = weighted_values(pending, x, missing, margin)
            return x, missing, margin, batch.column("node").to_numpy() if stored else None

        return read

    def fold_margins(self, trees: Sequence[tuple[dict, float]]) -> None:
        """Rewrite the table with the trees' values added to the margins."""
        read = self.reader(trees)

        def add(batches):
            for batch in batches:
                at = batch.schema.get_field_index("margin")
                yield batch.set_column(at, "margin", pa.array(read(batch)[2]))

        self.rewrite(self.table.mapInArrow(add, self.table.schema))
        self.stored_for = -1

    def keep_nodes(self, growth: Growth, tree_no: int) -> None:
        """Every few steps, rewrite the table with the nodes that rows have reached."""
        self.steps += 1
        if self.steps % LEVELS_PER_TABLE or not growth.children:
            return
        read, tree = self.reader((), tree_no), growth.arrays()

        def move(batches):
            for batch in batches:
                x, missing, _, node = read(batch)
                at = batch.schema.get_field_index("node")
                yield batch.set_column(at, "node", pa.array(leaf_of(tree, x, missing, node).astype(np.int32)))

        self.rewrite(self.table.mapInArrow(move, self.table.schema))
        self.stored_for = tree_no

    def begin_tree(self, pending: Sequence[tuple[dict, float]], tree_no: int) -> bool:
        """Called before a tree is grown; whether the pending trees were added to the margins."""
        self.steps = 0
        self.drop_sums()
        return False

    def drop_sums(self) -> None:
        self.kept = {}
        for path in self.passed:
            remove_folder(self.spark, path)
        self.passed = []

    # --- search ----------------------------------------------------------------------------

    def best_splits(self, growth: Growth, nodes: Sequence[int], pending, features, tree_no: int, last: bool) -> None:
        """Find the best split of some nodes; nodes without one get an empty dict. ``last``:
        no child of these nodes will be asked for."""
        self.keep_nodes(growth, tree_no)
        for found in self.search(growth, sorted(nodes), pending, features, tree_no, last):
            node = found["node"]
            if node == 0:
                growth.sums[0] = (found["g"], found["h"], found["n"])
            gain = found["gain"]
            if gain is not None and gain > MIN_GAIN and gain >= self.p["gamma"]:
                left = (found["left_g"], found["left_h"], found["left_n"])
                growth.split[node] = {
                    "gain": gain,
                    "feature": found["feature"],
                    "cut": found["cut"],
                    "default_left": found["default_left"],
                    "left": left,
                    "right": tuple(a - b for a, b in zip((found["g"], found["h"], found["n"]), left, strict=True)),
                }
        for node in nodes:
            if growth.split[node] is None:
                growth.split[node] = {}

    def search(self, growth: Growth, nodes, pending, features, tree_no, last) -> Iterator:
        raise NotImplementedError

    def rows_of_nodes(self, growth: Growth, nodes: Sequence[int], pending, tree_no: int):
        """batch -> (leaf, cells, g, h, times drawn or None, batch) of the rows drawn for this tree."""
        tree, logistic, p = growth.arrays(), self.logistic, self.p
        share, seed, bagging, grouped = p["subsample"], p["seed"], p.get("bagging", False), self.grouped
        read = self.reader(pending, tree_no)

        def rows(batch):
            n = None
            if grouped:
                n = batch.column("weight").to_numpy()
                keep = n > 0
                n = n[keep]
                batch = batch.filter(pa.array(keep))
            elif bagging:
                n = draws(batch.column("row").to_numpy(), seed, tree_no)
                keep = n > 0
                n = n[keep]
                batch = batch.filter(pa.array(keep))
            elif share < 1:
                batch = batch.filter(pa.array(sampled(batch.column("row").to_numpy(), seed, tree_no, share)))
            x, missing, margin, node = read(batch)
            g, h = gradients(margin, batch.column("y").to_numpy(), logistic)
            if n is not None:
                g, h = g * n, h * n
            return leaf_of(tree, x, missing, node), x, g, h, n, batch

        return rows

    def final(self, tree: dict) -> dict:
        """The tree with feature values as cuts."""
        return tree


class BinnedTable(TrainingTable):
    """Cuts at quantiles, the same for all trees."""

    #: All rows (row, y, code), where trees are grown on groups of the rows drawn for each.
    drawn_from: DataFrame | None = None
    #: What some trees draw from them, and its folder.
    drawn: DataFrame | None = None
    drawn_at: str | None = None

    def start(self, df, values):
        bins = self.p["max_bin"]
        # The maximum splits nothing off; the minimum splits off the rows equal to it.
        found = exact_quantiles(df, self.features, equal_frequency_probs(bins - 1))
        self.edges = [distinct_edges(found[f] or ())[:-1] for f in self.features]
        self.bins = max((len(e) for e in self.edges), default=0) + 1
        for i, edges in enumerate(self.edges):
            values = with_bin_number(values, f"b{i}", f"f{i}", edges)
        numbers = [F.coalesce(F.col(f"b{i}"), F.lit(-1)).cast("short") for i in range(len(self.features))]
        sizes = [len(e) + 2 for e in self.edges]  # with a place for missing values
        cells = math.prod(sizes)
        if cells * ROWS_PER_GROUP > self.rows:
            return values.select("y", F.array(*numbers).alias("bins"))
        self.grouped, self.rows = True, cells
        code, places, step = F.lit(0).cast("long"), [], 1
        for number, size in zip(numbers, sizes, strict=True):
            code += (number.cast("long") + 1) * step
            places.append(F.expr(f"CAST(code div {step} % {size} - 1 AS SMALLINT)"))
            step *= size
        coded = values.select("y", code.alias("code"))
        if self.p.get("bagging", False) or self.p["subsample"] < 1:
            # Each tree draws from the rows anew.
            path = f"{self.folder}/rows"
            coded.select(F.monotonically_increasing_id().alias("row"), "y", "code").write.parquet(path)
            self.drawn_from = coded = self.spark.read.schema("row long, y double, code long").parquet(path)
        groups = coded.groupBy("code").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("weight"))
        return groups.select("y", "weight", "code", F.array(*places).alias("bins"))

    def begin_tree(self, pending, tree_no):
        super().begin_tree(pending, tree_no)
        if self.drawn_from is None:
            return False
        at = tree_no % TREES_PER_DRAW
        if at == 0:
            # What a tree draws does not depend on the trees before it.
            self.draw(range(tree_no, min(tree_no + TREES_PER_DRAW, self.p["rounds"])))
        n, y = F.col(f"n{at}"), F.col(f"y{at}")
        found = self.drawn.where(n > 0).select("code", n.alias("weight"), (y / n).alias("y"))
        joined = self.table.drop("y", "weight").join(found, "code", "left")
        self.rewrite(joined.select([F.coalesce(c, F.lit(0.0)).alias(c) if c in ("y", "weight") else c for c in self.table.columns]))
        self.stored_for = -1
        return False

    def draw(self, trees: range) -> None:
        """A table of the rows drawn and their labels' sums per code, for each of some trees."""
        share, seed, bagging = self.p["subsample"], self.p["seed"], self.p.get("bagging", False)

        def draw(batches):
            def parts():
                for batch in batches:
                    row = batch.column("row").to_numpy()
                    times = [draws(row, seed, t) if bagging else sampled(row, seed, t, share).astype(float) for t in trees]
                    keep = np.any(times, axis=0)
                    yield batch.column("code").to_numpy()[keep], batch.column("y").to_numpy()[keep], *[n[keep] for n in times]

            for part in gathered(parts(), DRAWS_PER_SUM):
                yield drawn_batch(*part)

        found = self.drawn_from.mapInArrow(draw, drawn_fields(len(trees))).groupBy("code")
        found = found.agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(len(trees)) for c in "ny"])
        if self.drawn_at:
            self.passed.append(self.drawn_at)
        self.drawn_at = f"{self.folder}/drawn-{trees.start}"
        found.write.parquet(self.drawn_at)
        self.drawn = self.spark.read.schema(found.schema).parquet(self.drawn_at)

    def search(self, growth, nodes, pending, features, tree_no, last):
        width = len(features) * (self.bins + 1)
        # Of two siblings the one with fewer rows is summed.
        pairs, asked = [], set(nodes)
        for node in nodes:
            parent = growth.parent[node]
            sibling = next((c for c in growth.children.get(parent, ()) if c != node and c in asked), None)
            if parent in self.kept and sibling is not None:
                small, large = sorted((node, sibling), key=lambda c: (growth.sums[c][2], c))
                pairs.append((small, large, parent))
            else:
                pairs.append((node, None, None))
        pairs = sorted(set(pairs), key=lambda pair: pair[0])
        size = max(1, CELLS_PER_JOB // width)
        for start in range(0, len(pairs), size):
            yield from self._search(growth, pairs[start : start + size], pending, features, tree_no, last)

    def _search(self, growth, pairs, pending, features, tree_no, last):
        summed = [small for small, _, _ in pairs]
        rows, bins, unit = self.rows_of_nodes(growth, summed, pending, tree_no), self.bins, not self.logistic
        width = bins + 1

        def sums(batches):
            from pyspark import TaskContext

            found = GradientSums(sorted(summed), features, bins, unit)
            order = {node: i for i, node in enumerate(summed)}

            def parts():
                for batch in batches:
                    leaf, x, g, h, n, _ = rows(batch)
                    yield (leaf, x, g, h) if n is None else (leaf, x, g, h, n)

            for part in gathered(parts()):
                found.add(*part)
            place, feature, cells = found.rows()
            pair = np.array([order[n] for n in found.nodes.tolist()], dtype=np.int32)[place]
            # Some thousand rows at a time, as a batch of bytes holds 2 GB at most.
            for at in range(0, len(pair), 4096):
                yield sums_batch(pair[at : at + 4096], feature[at : at + 4096], TaskContext.get().partitionId(), cells[at : at + 4096])

        parents = [(i, parent) for i, (_, _, parent) in enumerate(pairs) if parent is not None]
        table = self.table.mapInArrow(sums, SUMS)
        for source in dict.fromkeys(self.kept[parent] for _, parent in parents):
            mine = [(i, parent) for i, parent in parents if self.kept[parent] is source]
            number = F.array_position(F.array(*[F.lit(parent) for _, parent in mine]), F.col("node")).cast("int")
            pair = F.element_at(F.array(*[F.lit(i) for i, _ in mine]), number)
            held = source.where(F.col("node").isin([parent for _, parent in mine]) & F.col("feature").isin(list(features)))
            table = table.unionByName(held.select(pair.alias("pair"), "feature", F.lit(-1).alias("part"), "sums"))
        p, keep = self.p, not last and self.rows * len(features) >= KEEP_CELLS

        def combine(batches):
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            pair, feature, part = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("pair", "feature", "part"))
            cells = np.concatenate([cells_of(b.column("sums"), width) for b in held])
            key = pair.astype(np.int64) << 32 | feature
            own = part >= 0
            found, total = added_up(key[own], part[own], cells[own])
            above, whole = added_up(key[~own], part[~own], cells[~own])
            node = np.array([pairs[i][0] for i in (found >> 32).tolist()], dtype=np.int32)
            number = (found & 0xFFFFFFFF).astype(np.int32)
            yield cuts_batch(node, number, total, p, keep)
            if len(above):
                # A sibling's sums; where it has no rows, rounding must not leave any.
                rest = whole.copy()
                at = np.searchsorted(above, found)
                rest[at] -= total
                rest[np.broadcast_to(rest[:, 2:] < 0.5, rest.shape)] = 0.0
                node = np.array([pairs[i][1] for i in (above >> 32).tolist()], dtype=np.int32)
                yield cuts_batch(node, (above & 0xFFFFFFFF).astype(np.int32), rest, p, keep)

        parts = -(-self.tasks * len(pairs) * len(features) * 3 * 8 * width // BYTES_PER_PARTITION)
        limit = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        cuts = table.repartition(min(parts, limit), "pair", "feature").mapInArrow(combine, CUTS)
        if keep:
            path = f"{self.folder}/sums-{self.step}"
            self.step += 1
            cuts.write.parquet(path)
            self.passed.append(path)
            cuts = self.spark.read.schema(cuts.schema).parquet(path)
            for small, large, _ in pairs:
                self.kept[small] = cuts
                if large is not None:
                    self.kept[large] = cuts
        best = F.struct("feature", "gain", "cut", "default_left", "left_g", "left_h", "left_n", "g", "h", "n")
        order = F.struct(F.coalesce("gain", F.lit(float("-inf"))), -F.col("feature"))
        for r in cuts.groupBy("node").agg(F.max_by(best, order).alias("best")).collect():
            yield {"node": r["node"], **r["best"].asDict()}

    def final(self, tree):
        """Bin numbers replaced by feature values. A cut after the last bin parts known values
        from missing ones."""
        cut = [[*self.edges[f], np.inf][int(c)] if f >= 0 else 0.0 for f, c in zip(tree["feature"], tree["cut"])]
        return {**tree, "cut": np.array(cut, dtype=float)}


class WeightedTable(BinnedTable):
    """Cuts at quantiles weighted by curvature, proposed anew for each tree."""

    def start(self, df, values):
        self.edges = [[] for _ in self.features]
        self.bins = 1
        empty = F.array(*[F.lit(-1).cast("short") for _ in self.features])
        return values.select("y", F.array(*[f"f{i}" for i in range(len(self.features))]).alias("x"), empty.alias("bins"))

    def begin_tree(self, pending, tree_no):
        super().begin_tree(pending, tree_no)
        read, width, logistic = self.reader(pending), len(self.features), self.logistic
        size = SUMMARY_ENTRIES * self.p["max_bin"]

        def summaries(batches):
            from pyspark import TaskContext

            def parts():
                for batch in batches:
                    _, h = gradients(read(batch)[2], batch.column("y").to_numpy(), logistic)
                    yield cell_matrix(batch, "x", width), h

            found = Summaries(width, size)
            for part in gathered(parts()):
                found.add(*part)
            results = [found.result(f) for f in range(width)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(width), pa.int32()),
                    pa.array([TaskContext.get().partitionId()] * width, pa.int32()),
                    pa.array([s.tobytes() for s in results], pa.binary()),
                ],
                names=["feature", "part", "summary"],
            )

        def merge(group: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros((4, 0))
            for s in group.sort_values("part")["summary"]:
                out = merged_summary(out, np.frombuffer(s).reshape(4, -1))
            first = group.iloc[0]
            return pd.DataFrame(
                {"feature": [first["feature"]], "part": [first["part"] // FAN_IN], "summary": [pruned_summary(out, size).tobytes()]}
            )

        schema = "feature int, part int, summary binary"
        found = self.table.mapInArrow(summaries, schema)
        left = self.tasks
        while True:  # a tree of merges, FAN_IN summaries each
            found = found.groupBy("feature", F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, schema)
            left = -(-left // FAN_IN)
            if left <= 1:
                break
        cuts = self.p["max_bin"] - 1
        edges = {r["feature"]: summary_cuts(np.frombuffer(r["summary"]).reshape(4, -1), cuts) for r in found.collect()}
        edges = [edges.get(f, []) for f in range(width)]

        def rebin(batches):
            for batch in batches:
                margin, x = read(batch)[2], cell_matrix(batch, "x", width)
                bins = np.empty(x.shape, np.int16)
                for f in range(width):
                    bins[:, f] = np.where(np.isnan(x[:, f]), -1, np.searchsorted(edges[f], x[:, f]))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
                cells = pa.ListArray.from_arrays(offsets, pa.array(bins.ravel()))
                for name, column in (("margin", pa.array(margin)), ("bins", cells)):
                    batch = batch.set_column(batch.schema.get_field_index(name), name, column)
                yield batch

        self.rewrite(self.table.mapInArrow(rebin, self.table.schema))
        self.stored_for = -1
        self.edges, self.bins = edges, max(map(len, edges), default=0) + 1
        return True


class ValueTable(TrainingTable):
    """Every distinct value is a cut."""

    cells = "x"

    def start(self, df, values):
        # Ranges of a feature's values: some groups to scan for each shuffle partition. The sketch
        # only deals the rows; its bounds are literals, so a task run again sees the same ranges.
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        count = max(16, -(-4 * partitions // len(self.features)))
        names = [f"f{i}" for i in range(len(self.features))]
        shares = [i / count for i in range(1, count)]
        for chunk in column_chunks(names):
            found = values.agg(*[F.percentile_approx(f, shares, max(1000, 10 * count)).alias(f) for f in chunk]).first()
            for f in chunk:
                values = with_bin_number(values, f"r{f}", f, sorted(set(found[f] or ())))
        ranges = [F.coalesce(F.col(f"r{f}"), F.lit(-1)).cast("int") for f in names]
        return values.select("y", F.array(*names).alias("x"), F.array(*ranges).alias("ranges"))

    def search(self, growth, nodes, pending, features, tree_no, last):
        rows, p = self.rows_of_nodes(growth, nodes, pending, tree_no), self.p

        def located(batches):
            wanted = np.array(sorted(nodes))
            for batch in batches:
                leaf, _, g, h, _, drawn = rows(batch)
                here = np.isin(leaf, wanted)
                drawn = drawn.filter(pa.array(here))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[here].astype(np.int32)), pa.array(g[here]), pa.array(h[here]), drawn.column("x"), drawn.column("ranges")],
                    names=["node", "g", "h", "x", "ranges"],
                )

        read = self.table.mapInArrow(located, "node int, g double, h double, x array<double>, ranges array<int>")
        cell = F.posexplode(F.arrays_zip("x", "ranges")).alias("feature", "cell")
        cells = read.select("node", "g", "h", cell)
        if len(features) < len(self.features):
            cells = cells.where(F.col("feature").isin(list(features)))
        sums = [F.sum("g").alias("g"), F.sum("h").alias("h")]
        cells = cells.groupBy("node", "feature", F.col("cell.ranges").alias("range"), F.col("cell.x").alias("x")).agg(
            *sums, F.count(F.lit(1)).cast("double").alias("n")
        )
        # Totals before each range, of missing values (range -1), and of the node.
        whole = Window.partitionBy("node", "feature")
        before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        is_missing = F.col("range") < 0
        totals = cells.groupBy("node", "feature", "range").agg(*[F.sum(c).alias(c) for c in "ghn"])
        totals = totals.select(
            "node", "feature", "range",
            *[F.coalesce(F.sum(F.when(~is_missing, F.col(c))).over(before), F.lit(0.0)).alias(f"before_{c}") for c in "ghn"],
            *[F.coalesce(F.sum(F.when(is_missing, F.col(c))).over(whole), F.lit(0.0)).alias(f"missing_{c}") for c in "ghn"],
            *[F.sum(c).over(whole).alias(f"total_{c}") for c in "ghn"],
        )
        inside = Window.partitionBy("node", "feature", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        scanned = cells.join(totals, ["node", "feature", "range"]).select(
            "node", "feature", "range", "x", *[f"total_{c}" for c in "ghn"], *[f"missing_{c}" for c in "ghn"],
            *[(F.col(f"before_{c}") + F.sum(c).over(inside)).alias(f"upto_{c}") for c in "ghn"],
        )
        best = scanned.where(F.col("range") >= 0).select("node", F.explode(F.array(*[self._candidate(p, s) for s in (False, True)])).alias("c"))
        # The greatest gain; then the first feature, the smallest cut, missing values on the right.
        found = best.groupBy("node").agg(F.max("c").alias("c"))
        totals = totals.groupBy("node").agg(*[F.min_by(f"total_{c}", "feature").alias(c) for c in "ghn"])
        for r in totals.join(found, "node", "left").collect():
            c = r["c"]
            cut = {} if c is None else {
                "gain": c["gain"], "feature": -c["feature"], "cut": c["cut"], "default_left": not c["right"],
                **{f"left_{k}": c[f"left_{k}"] for k in "ghn"},
            }
            yield {"node": r["node"], "gain": None, **{k: r[k] for k in "ghn"}, **cut}

    @staticmethod
    def _candidate(p: dict, missing_left: bool) -> Column:
        """The cut after this value as a struct that compares by merit; null if not allowed."""
        left = {c: F.col(f"upto_{c}") + (F.col(f"missing_{c}") if missing_left else 0.0) for c in "ghn"}
        right = {c: F.col(f"total_{c}") - left[c] for c in "ghn"}
        total = {c: F.col(f"total_{c}") for c in "ghn"}

        def strength(s: dict) -> Column:
            t = F.greatest(F.abs(s["g"]) - p["alpha"], F.lit(0.0))
            bottom = s["h"] + p["lambda"]
            return F.when(bottom > 0, t * t / bottom).otherwise(F.lit(0.0))

        allowed = F.lit(True)
        for s in (left, right):
            allowed &= (s["n"] > 0.5) & (s["n"] >= p["min_rows"]) & (s["h"] >= p["min_child_weight"])
        if missing_left:
            allowed &= F.col("missing_n") > 0
        # After a node's last value only missing ones remain: unseen greater values stay left.
        last = F.col("upto_n") + F.col("missing_n") >= F.col("total_n") - 0.5
        gain = strength(left) + strength(right) - strength(total)
        return F.when(
            allowed,
            F.struct(
                gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("x")).alias("before"), F.lit(not missing_left).alias("right"),
                F.when(last, F.lit(float("inf"))).otherwise(F.col("x")).alias("cut"), *[left[c].alias(f"left_{c}") for c in "ghn"],
            ),
        )


def training_table(method: str) -> type[TrainingTable]:
    return {"exact": ValueTable, "approx": WeightedTable}.get(method, BinnedTable)
