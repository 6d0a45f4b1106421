"""Logistic and ridge regression with sklearn-style penalties, trained by MLlib."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import double_array
from ..functions.trees import gradients
from ..params import column_list, resolve
from ..schema import col, require_columns
from .project import label_number, missing_count, numeric_columns, reject_missing, training_features

# MLlib solves the normal equations up to so many features; both solvers give one answer.
NORMAL_FEATURES = 4096
# Columns whose products one scan sums for boosting in steps.
STEP_COLUMNS = 512


@dataclass(frozen=True)
class LinearModel:
    """intercept + sum of coefficient * feature, through the logistic function if asked."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    logistic: bool
    model_type: str = "lr"

    def score(self, df: DataFrame) -> Column:
        # One array product, in the order of the features: a sum of thousands of terms
        # would be an expression too deep to compile.
        cells = F.array(*[col(name).cast("double") for name in self.features])
        terms = F.zip_with(cells, double_array(self.coefficients), lambda x, w: w * x)
        margin = F.aggregate(terms, F.lit(self.intercept), lambda total, term: total + term)
        if not self.logistic:
            return margin
        # Both branches keep the exponent negative, so nothing overflows.
        e = F.exp(-F.abs(margin))
        return F.when(margin >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def training_columns(df: DataFrame, ids, label) -> tuple[list[str], str]:
    ids = column_list("ids", ids)
    label = column_list("label", label, low=1, high=1)[0]
    require_columns(df, [*ids, label])
    features = training_features(df, ids, label)
    if not features:
        raise ValueError("no features to train on")
    odd = [f for f in features if f not in numeric_columns(df, features)]
    odd = [f for f in odd if df.schema[f].dataType.typeName() != "boolean"]
    if odd:
        raise ValueError(f"features must be numbers: {odd}")
    return features, label


def label_summary(df: DataFrame, features: Sequence[str], label: str, check_features: bool):
    """Label statistics and the checks on missing cells, in one pass."""
    y = label_number(df, label)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y.isNull()).alias("bad"),
        F.min(y).alias("low"),
        F.max(y).alias("high"),
        F.avg(y).alias("mean"),
        F.stddev_pop(y).alias("spread"),
        (missing_count(df, features) if check_features else F.lit(0)).alias("missing"),
    ).first()
    if row["n"] == 0:
        raise ValueError("the training table is empty")
    if row["bad"]:
        raise ValueError(f"{row['bad']} labels are missing or no numbers")
    reject_missing(row["missing"], "a linear model")
    return row


def binary_label(df: DataFrame, label: str, low: float, high: float) -> Column:
    """The greater of two classes as 1, the other as 0; anything else stops the job."""
    y = label_number(df, label)
    if low == high:
        raise ValueError("a classifier needs two classes")
    message = F.lit(f"label {label} has more than two classes")
    return (
        F.when(y == low, 0.0)
        .when(y == high, 1.0)
        .otherwise(F.raise_error(message).cast("double"))
    )


def fit_linear(
    df: DataFrame, features: Sequence[str], y: Column, logistic: bool, reg: float,
    elastic: float, max_iter: int, tol: float, spread: float, mean: float, model_type: str,
    rows: int,
) -> LinearModel:
    """``reg`` and ``elastic`` describe the penalty on the mean loss in label units."""
    data = df.select(y.alias("__y"), *[col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)])
    vectors = VectorAssembler(inputCols=data.columns[1:], outputCol="__x")
    data = vectors.transform(data).select("__y", "__x")
    shared = {"featuresCol": "__x", "labelCol": "__y", "maxIter": max_iter, "tol": tol,
              "standardization": False}
    if logistic:
        fitted = LogisticRegression(
            regParam=reg, elasticNetParam=elastic, family="binomial", **shared
        ).fit(data)
    elif spread == 0:
        return LinearModel(tuple(features), (0.0,) * len(features), mean, False, model_type)
    else:
        # The solver works on the label divided by its deviation, which scales the
        # quadratic part of the penalty but not the absolute one. The iterative solver
        # divides by the sample's deviation, and runs until it has converged.
        normal = len(features) <= NORMAL_FEATURES
        if not normal:
            spread *= math.sqrt(rows / max(rows - 1, 1))
            shared |= {"maxIter": max(max_iter, 10_000), "tol": min(tol, 1e-10)}
        square, absolute = reg * (1 - elastic) * spread, reg * elastic
        total = square + absolute
        fitted = LinearRegression(
            regParam=total,
            elasticNetParam=absolute / total if total else 0.0,
            solver="normal" if normal else "l-bfgs",
            **shared,
        ).fit(data)
    return LinearModel(
        tuple(features),
        tuple(float(c) for c in fitted.coefficients),
        float(fitted.intercept),
        logistic,
        model_type,
    )


def boosted_linear(
    df: DataFrame, features: Sequence[str], y: Column, logistic: bool, p: dict, base: float, rows: int
) -> LinearModel:
    """``num_boost_round`` rounds of cyclic coordinate descent from zero weights: first the
    intercept, then one feature after another takes ``learning_rate`` of the step that would be
    best for it alone, with penalties of ``lambda`` and ``alpha`` times the rows.

    A step changes all gradients linearly, so the products of some columns tell what every later
    step of the round will meet: one scan per round and block of columns (one in all for
    squared error and a single block), and the driver holds a block's products only.
    """
    k, rate = len(features), p["learning_rate"]
    l2, l1 = p["lambda"] * rows, p["alpha"] * rows
    cells = df.select(y.alias("y"), F.array(*[col(f).cast("double") for f in features]).alias("x"))
    intercept, weights = base, np.zeros(k)
    blocks = [np.arange(s, min(s + STEP_COLUMNS, k)) for s in range(0, k, STEP_COLUMNS)]
    known = False
    for _ in range(p["num_boost_round"]):
        for i, block in enumerate(blocks):
            if not known or logistic or len(blocks) > 1:  # else the gradient has followed every step
                curvature, gradient = _products(cells, block, intercept, weights, logistic)
                known = True
            # Place 0 is the intercept, which takes its step at the start of the round.
            steps = np.zeros(len(block) + 1)
            if i == 0:
                steps[0] = -rate * gradient[0] / curvature[0, 0] if curvature[0, 0] > 0 else 0.0
                gradient = gradient + curvature[0] * steps[0]
            for at, j in enumerate(block, start=1):
                steps[at] = rate * _best_step(gradient[at], curvature[at, at], weights[j], l1, l2)
                gradient = gradient + curvature[at] * steps[at]
            intercept += steps[0]
            weights[block] += steps[1:]
    return LinearModel(tuple(features), tuple(map(float, weights)), float(intercept), logistic, "xgb")


def _best_step(g: float, h: float, w: float, l1: float, l2: float) -> float:
    """The change of one weight that is best for it alone; none across zero."""
    if h + l2 <= 0:
        return 0.0
    pull = g + l2 * w
    if w - pull / (h + l2) >= 0:
        return max(-(pull + l1) / (h + l2), -w)
    return min(-(pull - l1) / (h + l2), -w)


def _products(cells: DataFrame, block: np.ndarray, intercept: float, weights: np.ndarray, logistic: bool):
    """Sums over the rows of h z z' and g z, for z one and the block's columns."""
    k, size = len(weights), len(block) + 1
    upper = np.flatnonzero(np.triu(np.ones((size, size))))

    def run(batches):
        second, first = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            g, h = gradients(intercept + x @ weights, batch.column("y").to_numpy(zero_copy_only=False), logistic)
            z = np.column_stack([np.ones(len(x)), x[:, block]])
            second += (z * h[:, None]).T @ z
            first += z.T @ g
        cell = np.r_[upper, size * size + np.arange(size)].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.r_[second.ravel()[upper], first])], names=["cell", "total"])

    summed = cells.mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(size * size + size)
    out[summed["cell"].to_numpy()] = summed["total"].to_numpy()
    second = out[: size * size].reshape(size, size)
    return second + np.triu(second, 1).T, out[size * size :]


def lr_train(df: DataFrame, label, ids=(), **attributes) -> LinearModel:
    """Train on all features but the ids and the label.

    Logistic: mean log loss with l2_norm/n times the penalty; penalty l2, l1, elasticnet
    (half and half) or None. Linear: squared error with l2_norm on the squared weights.
    The intercept is never penalised and features are not scaled.
    Attributes: max_iter, reg_type, l2_norm, tol, penalty.
    """
    p = resolve("lr_train", attributes)
    features, label = training_columns(df, ids, label)
    s = label_summary(df, features, label, check_features=True)
    reg = p["l2_norm"] / s["n"]
    if p["reg_type"] == "linear":
        y, elastic = label_number(df, label), 0.0
    else:
        y = binary_label(df, label, s["low"], s["high"])
        elastic = {"l1": 1.0, "elasticnet": 0.5}.get(p["penalty"], 0.0)
        reg = 0.0 if p["penalty"] in (None, "None") else reg
    return fit_linear(
        df, features, y, p["reg_type"] == "logistic", reg, elastic, p["max_iter"], p["tol"],
        s["spread"] or 0.0, s["mean"], "lr", s["n"],
    )
