"""Reports on predictions: ROC curve, binary classification report, prediction bias."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import (
    distinct_edges,
    equal_frequency_probs,
    equal_width_edges,
    with_bin_number,
)
from ..functions.ordered import range_bounds, range_count, running_totals
from ..functions.quantiles import resolve_quantiles, sketch_aggregates
from ..params import column_list, resolve
from ..schema import col, require_columns
from .project import label_number

# False-positive rates the head report looks up: fixed values.
HEAD_FPR = (0.001, 0.005, 0.01, 0.05, 0.1, 0.2)
DECISION_THRESHOLD = 0.5
UNDEFINED = -1.0

# Columns of a bin row, in report order: fixed values.
BIN_COLUMNS = (
    ("start_value", "double"),
    ("end_value", "double"),
    ("positive", "long"),
    ("negative", "long"),
    ("total", "long"),
    ("precision", "double"),
    ("recall", "double"),
    ("false_positive_rate", "double"),
    ("f1_score", "double"),
    ("lift", "double"),
    ("distribution_of_positive", "double"),
    ("distribution_of_negative", "double"),
    ("cumulative_percent_of_positive", "double"),
    ("cumulative_percent_of_negative", "double"),
    ("total_cumulative_percent", "double"),
    ("ks", "double"),
    ("avg_score", "double"),
)
BIAS_SCHEMA = (
    "interval string, left_endpoint double, left_closed boolean, right_endpoint double,"
    " right_closed boolean, is_na boolean, avg_prediction double, avg_label double, bias double"
)


class BiclassReport(NamedTuple):
    summary: DataFrame
    eq_frequent_bins: DataFrame
    eq_range_bins: DataFrame
    head: DataFrame


def _scored(df: DataFrame, label, score) -> DataFrame:
    """(y, score) as doubles, null for missing; nothing else is read."""
    label = column_list("label", label, low=1, high=1)[0]
    score = column_list("score", score, low=1, high=1)[0]
    require_columns(df, [label, score])
    missing = F.lit(None).cast("double")
    return df.select(
        label_number(df, label).alias("y"),
        F.nanvl(col(score).cast("double"), missing).alias("score"),
    )


def _profile(scored: DataFrame, probs: Sequence[float], ranges: int = 0):
    """Counts, score range and sketches. The sketches are their own pass: next to them the
    counts would not be compiled."""
    counts = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("neg"),
        F.count_if(F.col("y").isNull() | F.col("score").isNull()).alias("missing"),
        F.count_if(F.col("score") >= DECISION_THRESHOLD).alias("called"),
        F.count_if((F.col("score") >= DECISION_THRESHOLD) & (F.col("y") == 1)).alias("hits"),
    ]
    row = scored.agg(*counts, F.min("score").alias("low"), F.max("score").alias("high"))
    row = row.first().asDict()
    if row["rows"] == 0:
        raise ValueError("the table is empty")
    if row["missing"]:
        raise ValueError(f"{row['missing']} rows miss the label or the score")
    sketches = sketch_aggregates(["score"], probs) if probs else []
    if ranges:
        inner = [i / ranges for i in range(1, ranges)]
        accuracy = max(1000, 10 * ranges)
        sketches.append(F.percentile_approx("score", inner, accuracy).alias("ranges"))
    if sketches:
        row |= scored.agg(*sketches).first().asDict()
    return row


def _require_binary(profile) -> None:
    other = profile["rows"] - profile["pos"] - profile["neg"]
    if other:
        raise ValueError(f"the label must be 0 or 1: {other} rows are neither")


def _curve(scored: DataFrame, profile) -> DataFrame:
    """One row per distinct score with the counts at or above it, and whether the point
    stays when collinear ones go. Hot scores fold into one row before the shuffle."""
    counted = scored.select(
        "score",
        F.when(F.col("y") == 1, 1).otherwise(0).cast("long").alias("pos"),
        F.when(F.col("y") == 0, 1).otherwise(0).cast("long").alias("neg"),
    )
    groups = counted.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    bounds = range_bounds(profile["ranges"], profile["high"])
    points = running_totals(counted, groups, "score", ("pos", "neg"), bounds)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    last = F.col("next_pos").isNull()
    turns = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    return points.withColumn("kept", first | last | turns)


def _share(count: Column, of: int) -> Column:
    return count / F.lit(float(of)) if of else F.lit(None).cast("double")


def roc_curve(df: DataFrame, label, score) -> DataFrame:
    """Points (threshold, fpr, tpr) for every distinct score, without interior points of
    straight runs, plus the origin at threshold infinity. Stays distributed."""
    scored = _scored(df, label, score)
    profile = _profile(scored, (), range_count(df))
    _require_binary(profile)
    points = _curve(scored, profile).where("kept").select(
        F.col("score").alias("threshold"),
        _share(F.col("cum_neg"), profile["neg"]).alias("fpr"),
        _share(F.col("cum_pos"), profile["pos"]).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(math.inf).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionAll(start)


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def _f1(hits: int, called: int, positives: int) -> float:
    return _ratio(2 * hits, called + positives)


def _curve_numbers(scored: DataFrame, profile) -> tuple[dict, list[tuple]]:
    """KS and AUC, and the head rows, in one aggregation over the curve."""
    pos, neg = profile["pos"], profile["neg"]
    points = _curve(scored, profile)
    fpr, tpr = _share(F.col("cum_neg"), neg), _share(F.col("cum_pos"), pos)
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / F.lit(2.0))
    point = F.struct("score", "cum_pos", "cum_neg")
    aggregates = [F.max(tpr - fpr).alias("ks"), F.sum(area).alias("area")]
    for i, target in enumerate(HEAD_FPR):
        distance = F.struct(F.abs(fpr - target), -F.col("score"))
        aggregates.append(F.min_by(point, F.when(F.col("kept"), distance)).alias(f"at{i}"))
    row = points.agg(*aggregates).first()
    head = []
    for i, target in enumerate(HEAD_FPR):
        threshold, tp, fp = row[f"at{i}"]
        if abs(0.0 - target) <= abs(fp / neg - target):
            # The origin comes first, so it wins ties.
            head.append((f"case_{i}", math.inf, 0.0, 0.0, 0.0))
        else:
            head.append((f"case_{i}", threshold, fp / neg, tp / (tp + fp), tp / pos))
    return {"ks": max(0.0, row["ks"]), "auc": row["area"] / (pos * neg)}, head


def _bins(scored: DataFrame, edge_lists: Sequence[Sequence[float]], right_closed: bool):
    """Per list of edges: bin number -> aggregated row; all lists in one pass."""
    entries = []
    for i, edges in enumerate(edge_lists):
        scored = with_bin_number(scored, f"b{i}", "score", edges[1:-1], right_closed)
        entries.append(F.struct(F.lit(i).alias("list"), F.col(f"b{i}").alias("bin")))
    rows = (
        scored.select("y", "score", F.inline(F.array(entries)))
        .groupBy("list", "bin")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("y") == 1).alias("pos"),
            F.count_if(F.col("y") == 0).alias("neg"),
            F.min("score").alias("low"),
            F.max("score").alias("high"),
            F.avg("score").alias("avg_score"),
            F.avg("y").alias("avg_label"),
        )
        .collect()
    )
    out: list[dict] = [{} for _ in edge_lists]
    for r in rows:
        out[r["list"]][r["bin"]] = r
    return out


def _require_filled(row, at_least: int) -> None:
    if 0 < row["total"] < at_least:
        raise ValueError(f"a bin has {row['total']} rows, fewer than {at_least}")


def _bin_table(spark, bins: dict, count: int, pos: int, neg: int, at_least: int) -> DataFrame:
    """Rows from the highest scores down; rates are of everything at or above the bin."""
    total, rows, tp, fp = pos + neg, [], 0, 0

    def rate(part: float, of: int) -> float:
        return part / of if of else UNDEFINED

    for position, b in enumerate(reversed(range(count))):
        name, r = f"bin_{position}", bins.get(b)
        if r is None:
            rows.append((name, *[0 if kind == "long" else 0.0 for _, kind in BIN_COLUMNS]))
            continue
        _require_filled(r, at_least)
        tp, fp = tp + r["pos"], fp + r["neg"]
        precision = _ratio(tp, tp + fp)
        lift = precision * total / pos if pos else UNDEFINED
        rows.append(
            (name, r["low"], r["high"], r["pos"], r["neg"], r["total"])
            + (precision, _ratio(tp, pos), rate(fp, neg), _f1(tp, tp + fp, pos), lift)
            + (rate(r["pos"], pos), rate(r["neg"], neg), rate(tp, pos), rate(fp, neg))
            + ((tp + fp) / total, rate(tp, pos) - rate(fp, neg), r["avg_score"])
        )
    schema = ", ".join(["name string", *[f"{c} {kind}" for c, kind in BIN_COLUMNS]])
    return spark.createDataFrame(rows, schema)


def biclassification_eval(df: DataFrame, label, score, **attributes) -> BiclassReport:
    """Summary, equal-frequency bins, equal-range bins and head report of a score.

    Attributes: bucket_num, min_item_cnt_per_bucket. With a single class the AUC is -1, KS
    is null and the head report is empty.
    """
    p = resolve("biclassification_eval", attributes)
    scored = _scored(df, label, score)
    probs = equal_frequency_probs(p["bucket_num"])
    profile = _profile(scored, probs, range_count(df))
    _require_binary(profile)
    pos, neg = profile["pos"], profile["neg"]
    frequency = distinct_edges(
        resolve_quantiles(scored.select("score"), ["score"], probs, profile)["score"]
    )
    width = equal_width_edges(profile["low"], profile["high"], p["bucket_num"])
    found = _bins(scored, [frequency, width], right_closed=False)
    numbers, head = {"ks": None, "auc": UNDEFINED}, []
    if pos and neg:
        numbers, head = _curve_numbers(scored, profile)
    spark, at_least = df.sparkSession, p["min_item_cnt_per_bucket"]
    f1 = _f1(profile["hits"], profile["called"], pos)
    tables = [
        _bin_table(spark, bins, max(1, len(edges) - 1), pos, neg, at_least)
        for bins, edges in zip(found, (frequency, width))
    ]
    return BiclassReport(
        spark.createDataFrame(
            [(pos + neg, pos, neg, numbers["auc"], numbers["ks"], f1)],
            "total_samples long, positive_samples long, negative_samples long,"
            " auc double, ks double, f1_score double",
        ),
        *tables,
        spark.createDataFrame(
            head, "name string, threshold double, fpr double, precision double, recall double"
        ),
    )


def prediction_bias_eval(df: DataFrame, label, score, **attributes) -> DataFrame:
    """|average prediction - average label| per score bucket.

    Attributes: bucket_num, min_item_cnt_per_bucket, bucket_method.
    """
    p = resolve("prediction_bias_eval", attributes)
    scored = _scored(df, label, score)
    probs = equal_frequency_probs(p["bucket_num"])
    profile = _profile(scored, probs if p["bucket_method"] == "equal_frequency" else ())
    if p["bucket_method"] == "equal_width":
        edges = equal_width_edges(profile["low"], profile["high"], p["bucket_num"])
    else:
        quantiles = resolve_quantiles(scored.select("score"), ["score"], probs, profile)
        edges = distinct_edges(quantiles["score"])
    bins = _bins(scored, [edges], right_closed=True)[0] if len(edges) > 1 else {}
    rows = []
    for b, (left, right) in enumerate(zip(edges, edges[1:])):
        interval, r = f"({left}, {right}]", bins.get(b)
        ends = (interval, left, False, right, True)
        if r is None:
            rows.append((*ends, True, 0.0, 0.0, 0.0))
            continue
        _require_filled(r, p["min_item_cnt_per_bucket"])
        bias = abs(r["avg_score"] - r["avg_label"])
        rows.append((*ends, False, r["avg_score"], r["avg_label"], bias))
    return df.sparkSession.createDataFrame(rows, BIAS_SCHEMA)
