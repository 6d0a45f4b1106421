"""Gradient-boosted trees on binned features, grown level by level or best leaf first.

The training table is written once as bin numbers and rewritten with the margins after each
tree. Each level is one scan of it (see ``growth``); the best cut per node is found in Spark.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import double_sql
from ..functions.trees import weighted_values
from ..params import resolve
from ..schema import as_double, quoted
from .growth import Growth, TrainingTable, training_table
from .linear import (
    LinearModel,
    binary_label,
    boosted_linear,
    fit_linear,
    label_number,
    label_summary,
    reject_missing,
    training_columns,
)
from .project import missing_count

# Trees after which the margins in the table are brought up to date.
TREES_PER_TABLE = 1
# Up to here a model is scored by compiled comparisons, beyond by vectorised batches. A node takes
# up to 90 bytes of code, and the JIT leaves methods of more than 8000 to the interpreter.
EXPRESSION_NODES = 64

# Defaults of the leaf-wise trainer that have no attribute: fixed values.
LEAFWISE = {"max_bin": 255, "min_rows": 20, "min_child_weight": 1e-3}
DART = {"drop_rate": 0.1, "max_drop": 50, "skip_drop": 0.5}


@dataclass
class TreeModel:
    """Base margin plus weighted trees; through the logistic function if asked."""

    features: tuple[str, ...]
    base: float
    logistic: bool
    model_type: str
    trees: list[dict] = field(default_factory=list)

    def score(self, df: DataFrame) -> Column:
        if sum(len(t["feature"]) for t in self.trees) <= EXPRESSION_NODES:
            margin = F.lit(self.base)
            for tree in self.trees:
                margin = margin + F.expr(self._tree_sql(df, tree, 0))
        else:
            margin = self._batch_score(df)
        return 1 / (1 + F.exp(-margin)) if self.logistic else margin

    def _tree_sql(self, df: DataFrame, tree: dict, node: int) -> str:
        f = tree["feature"][node]
        if f < 0:
            return double_sql(tree["value"][node])
        name = self.features[f]
        x = f"CAST({quoted(name)} AS DOUBLE)"
        # NaN is greater than any number here, so it needs its own test.
        known = f"IF(isnan({x}), NULL, {x} <= {double_sql(tree['cut'][node])})"
        left = str(bool(tree["default_left"][node])).upper()
        return (
            f"IF(coalesce({known}, {left}), {self._tree_sql(df, tree, tree['left'][node])},"
            f" {self._tree_sql(df, tree, tree['right'][node])})"
        )

    def _batch_score(self, df: DataFrame) -> Column:
        shared = df.sparkSession.sparkContext.broadcast((self.base, self.trees))

        @F.pandas_udf("double")
        def margin(*columns: pd.Series) -> pd.Series:
            base, trees = shared.value
            x = np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns])
            return pd.Series(weighted_values([(t, 1.0) for t in trees], x, np.isnan(x), base))

        return margin(*[as_double(df, f) for f in self.features])


class _Trainer:
    """Grows trees on a training table, level by level or best leaf first."""

    def __init__(self, table: TrainingTable, p: dict):
        self.table, self.p = table, p

    def leaf_value(self, growth: Growth, node: int) -> float:
        g, h, _ = growth.sums[node]
        strength = math.copysign(max(abs(g) - self.p["alpha"], 0.0), g)
        bottom = h + self.p["lambda"]
        return -self.p["learning_rate"] * strength / bottom if bottom > 0 else 0.0

    def grow_by_level(self, pending, features, tree_no) -> dict:
        growth, level, leaves = Growth(), [0], 1
        for depth in range(self.p["max_depth"]):
            last = depth + 1 == self.p["max_depth"]
            self.table.best_splits(growth, level, pending, features, tree_no, last)
            following = []
            for node in level:
                if growth.split[node] and (not self.p["max_leaves"] or leaves < self.p["max_leaves"]):
                    following += growth.expand(node)
                    leaves += 1
            level = following
            if not level:
                break
        return self._finished(growth, set(growth.children))

    def grow_by_leaf(self, pending, features, tree_no) -> dict:
        """Always split the leaf with the greatest gain next. Children of every leaf that
        may still be chosen are looked at in one job, so there is about one job per
        level instead of one per leaf; the choice itself stays strictly one at a time."""
        growth, budget = Growth(), self.p["num_leaves"]
        self.table.best_splits(growth, [0], pending, features, tree_no, budget == 2)
        while True:
            chosen, leaves, ready = set(), 1, True
            heap = [0] if growth.split[0] else []
            while heap and leaves < budget:
                best = max(heap, key=lambda n: (growth.split[n]["gain"], -n))
                children = growth.children.get(best)
                if leaves + 1 < budget and (
                    children is None or any(growth.split[c] is None for c in children)
                ):
                    ready = False
                    break
                chosen.add(best)
                heap.remove(best)
                leaves += 1
                heap += [c for c in growth.expand(best) if growth.split[c]]
            if ready:
                return self._finished(growth, chosen)
            heap.sort(key=lambda n: (-growth.split[n]["gain"], n))
            wanted = [c for n in heap[: budget - leaves] for c in growth.expand(n)]
            wanted = [c for c in wanted if growth.split[c] is None]
            self.table.best_splits(growth, wanted, pending, features, tree_no, False)

    def _finished(self, growth: Growth, chosen: set[int]) -> dict:
        return growth.arrays(chosen, lambda node: self.leaf_value(growth, node))


def _boost(trainer: _Trainer, rounds: int, grow, mode: str = "gbdt") -> list[dict]:
    """Trees of all rounds, with final weights. Modes: gbdt, dart (some earlier trees are
    left out of a round and share its weight), rf (every tree starts from the base)."""
    table, p, rng = trainer.table, trainer.p, random.Random(trainer.p["seed"])
    count = len(table.features)
    sampled_features = max(1, int(p["colsample_bytree"] * count))
    trees: list[dict] = []
    finished: list[dict] = []
    weights: list[float] = []
    stored: list[float] = []
    for tree_no in range(rounds):
        features = sorted(rng.sample(range(count), sampled_features))
        dropped: list[int] = []
        if mode == "dart" and trees and rng.random() >= DART["skip_drop"]:
            dropped = [i for i in range(len(trees)) if rng.random() < DART["drop_rate"]]
            if len(dropped) > DART["max_drop"]:
                dropped = sorted(rng.sample(dropped, DART["max_drop"]))
        pending = []
        if mode != "rf":
            now = [0.0 if i in dropped else w for i, w in enumerate(weights)]
            pending = [(t, a - b) for t, a, b in zip(trees, now, stored) if a != b]
            folded = table.begin_tree(pending, tree_no)
            if pending and not folded and tree_no % TREES_PER_TABLE == 0:
                table.fold_margins(pending)
                folded = True
            if folded:
                pending, stored = [], now
        else:
            table.begin_tree([], tree_no)
        tree = grow(pending, features, tree_no)
        trees.append(tree)
        finished.append(table.final(tree))
        weights.append(1.0 / (1 + len(dropped)))
        stored.append(0.0)
        for i in dropped:
            weights[i] *= len(dropped) / (1 + len(dropped))
    if mode == "rf":
        weights = [1.0 / rounds] * rounds
    return [{**t, "value": t["value"] * w} for t, w in zip(finished, weights)]


def _log_odds(share: float) -> float:
    return math.log(share / (1 - share))


def xgb_train(df: DataFrame, label, ids=(), linear_steps: bool = False, **attributes) -> TreeModel | LinearModel:
    """Level-wise boosted trees with second-order gains (Chen & Guestrin 2016), missing
    values sent to the better side; or a penalised linear model (booster gblinear).

    Gains carry no factor 1/2; splits need a gain of at least gamma. Tree methods differ
    only in the cut points: quantiles (hist, auto), quantiles weighted by curvature and
    proposed anew for each tree (approx), or every value (exact). Booster dart drops no trees,
    as there is no attribute for a drop rate. Booster gblinear solves its penalised problem;
    with ``linear_steps`` it takes ``num_boost_round`` rounds of steps by ``learning_rate``.
    Attributes: those of level-wise boosting, with ``lambda`` passed as ``**{"lambda": v}``.
    """
    p = resolve("xgb_train", attributes)
    features, label = training_columns(df, ids, label)
    logistic = p["objective"] == "binary:logistic"
    s = label_summary(df, features, label, check_features=False)
    if logistic and not (s["low"] == 0 and s["high"] == 1):
        raise ValueError("binary:logistic needs labels 0 and 1")
    y = binary_label(df, label, 0.0, 1.0) if logistic else label_number(df, label)
    if p["booster"] == "gblinear":
        reject_missing(df.agg(missing_count(df, features)).first()[0], "gblinear")
        if linear_steps:
            base = _log_odds(p["base_score"]) if logistic else p["base_score"]
            return boosted_linear(df, features, y, logistic, p, base, s["n"])
        reg = p["lambda"] + p["alpha"]
        return fit_linear(
            df, features, y, logistic, reg, p["alpha"] / reg if reg else 0.0,
            p["num_boost_round"], 1e-6, s["spread"] or 0.0, s["mean"], "xgb", s["n"],
        )
    base = _log_odds(p["base_score"]) if logistic else p["base_score"]
    settings = {**p, "min_rows": 0, "rounds": p["num_boost_round"]}
    table = training_table(p["tree_method"])(df, features, y, base, logistic, settings, s["n"])
    trainer = _Trainer(table, settings)
    try:
        trees = _boost(trainer, p["num_boost_round"], trainer.grow_by_level)
    finally:
        table.close()
    return TreeModel(tuple(features), base, logistic, "xgb", trees)


def lgbm_train(df: DataFrame, label, ids=(), seed: int = 42, **attributes) -> TreeModel:
    """Leaf-wise boosted trees (gbdt), the same with dropout (dart), or a random forest
    (rf: every tree fits the base prediction on rows drawn with replacement, each as often as
    a Poisson number with mean 1 by hash says, and they average).
    Attributes: n_estimators, objective, boosting_type, learning_rate, num_leaves.
    """
    p = resolve("lgbm_train", attributes)
    features, label = training_columns(df, ids, label)
    logistic = p["objective"] == "binary"
    s = label_summary(df, features, label, check_features=False)
    y = label_number(df, label)
    if logistic:
        y = binary_label(df, label, s["low"], s["high"])
        base = _log_odds((s["mean"] - s["low"]) / (s["high"] - s["low"]))
    else:
        base = s["mean"]
    forest = p["boosting_type"] == "rf"
    settings = {
        "num_leaves": p["num_leaves"],
        "learning_rate": 1.0 if forest else p["learning_rate"],
        "lambda": 0.0,
        "alpha": 0.0,
        "gamma": 0.0,
        "colsample_bytree": 1.0,
        "subsample": 1.0,
        "bagging": forest,
        "rounds": p["n_estimators"],
        "seed": seed,
        **LEAFWISE,
    }
    table = training_table("hist")(df, features, y, base, logistic, settings, s["n"])
    trainer = _Trainer(table, settings)
    try:
        trees = _boost(trainer, p["n_estimators"], trainer.grow_by_leaf, p["boosting_type"])
    finally:
        table.close()
    return TreeModel(tuple(features), base, logistic, "lgbm", trees)
