"""Weight-of-evidence binning rules and their substitution."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bins import (
    double_array,
    distinct_edges,
    equal_frequency_probs,
    equal_width_edges,
    rounded_edges,
    with_bin_number,
)
from ..functions.quantiles import column_chunks, exact_quantiles
from ..params import column_list, resolve
from ..schema import FEATURE, LABEL, as_double, col, columns_with_role, require_columns

RULE_SCHEMA = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField(
            "bins",
            T.ArrayType(
                T.StructType(
                    [T.StructField("right", T.DoubleType()), T.StructField("woe", T.DoubleType())]
                )
            ),
        ),
        T.StructField("else_woe", T.DoubleType()),
    ]
)
ELSE = "else"


class WoeBinning(NamedTuple):
    rules: DataFrame
    report: DataFrame


def bin_edges(df: DataFrame, features: Sequence[str], method: str, bins: int) -> dict[str, list]:
    """feature -> ascending edges of its equal-frequency (quantile) or equal-width (bucket)
    bins. Fewer than two edges mean no bins."""
    features = column_list("feature_selects", features, low=1)
    require_columns(df, features)
    if method == "quantile":
        found = exact_quantiles(df, features, equal_frequency_probs(bins))
        return {f: distinct_edges(q or ()) for f, q in found.items()}
    if method != "bucket":
        raise ValueError(f"unsupported binning_method {method!r}")
    out = {}
    for chunk in column_chunks(features):
        part = df.select([as_double(df, f) for f in chunk])
        aggregates = [
            fn(col(f)).alias(f"{tag}{i}")
            for i, f in enumerate(chunk)
            for tag, fn in (("lo", F.min), ("hi", F.max))
        ]
        row = part.agg(*aggregates).first()
        for i, f in enumerate(chunk):
            low, high = row[f"lo{i}"], row[f"hi{i}"]
            out[f] = [] if low is None else equal_width_edges(low, high, bins)
    return out


def _is_positive(df: DataFrame, label: str, positive_label: str) -> Column:
    kind = df.schema[label].dataType
    if isinstance(kind, T.BooleanType):
        words = {"1": True, "true": True, "0": False, "false": False}
        if positive_label.lower() not in words:
            raise ValueError(f"positive_label {positive_label!r} is no bool")
        return col(label) == F.lit(words[positive_label.lower()])
    if isinstance(kind, T.NumericType):
        return col(label).cast("double") == F.lit(float(positive_label))
    return col(label).cast("string") == F.lit(positive_label)


def _bin_counts(df, edges, features, label, positive_label) -> DataFrame:
    """(feature, bin, total, pos) for all features in one aggregation; bin -1 is missing."""
    positive = _is_positive(df, label, positive_label)
    known = col(label).isNotNull()
    if isinstance(df.schema[label].dataType, (T.DoubleType, T.FloatType)):
        known = known & ~F.isnan(col(label))
    parts = []
    for chunk in column_chunks(features):
        part = df.select(
            *[as_double(df, f).alias(f"f{i}") for i, f in enumerate(chunk)],
            F.when(known, F.coalesce(positive, F.lit(False)).cast("int")).alias("positive"),
        )
        entries = []
        for i, f in enumerate(chunk):
            # A feature without bins keeps its rows in no bin at all.
            part = with_bin_number(part, f"b{i}", f"f{i}", edges[f][1:-1])
            number = F.col(f"b{i}") if len(edges[f]) > 1 else F.lit(None)
            number = F.when(F.col(f"f{i}").isNull(), F.lit(-1)).otherwise(number)
            entries.append(F.struct(F.lit(f).alias("feature"), number.alias("bin")))
        rows = part.select("positive", F.inline(F.array(entries))).where(F.col("bin").isNotNull())
        parts.append(
            rows.groupBy("feature", "bin").agg(
                F.count("positive").alias("total"),
                F.coalesce(F.sum("positive"), F.lit(0)).alias("pos"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def woe_binning(
    df: DataFrame,
    feature_selects: Sequence[str] | str,
    label: str | Sequence[str] | None = None,
    exact_edges: bool = False,
    **attributes,
) -> WoeBinning:
    """Bin features and compute each bin's weight of evidence against the positive label.

    Rows without a value form the ``else`` bin. Counts below 1 become 0.5 before the rates
    are taken. The rule's edges are rounded as bin labels show them, which may move rows
    between an edge and its rounding; ``exact_edges=True`` keeps the counted edges.
    Attributes: binning_method, positive_label, bin_num.
    """
    p = resolve("woe_binning", attributes)
    features = column_list("feature_selects", feature_selects, low=1)
    label = column_list("label", label or columns_with_role(df, LABEL), low=1, high=1)[0]
    require_columns(df, [*features, label])
    edges = bin_edges(df, features, p["binning_method"], p["bin_num"])
    counts = _bin_counts(df, edges, features, label, p["positive_label"])

    # At most features x (bins + 1) rows come back; the rest is arithmetic on them.
    found = {(r["feature"], r["bin"]): (r["total"], r["pos"]) for r in counts.collect()}
    rules, report = [], []
    for f in features:
        shown = rounded_edges(edges[f])
        right = edges[f] if exact_edges else shown
        bins = list(range(len(edges[f]) - 1))
        labels = {b: f"({shown[b]}, {shown[b + 1]}]" for b in bins}
        if (f, -1) in found:
            labels[-1] = ELSE
        rows = [(b, *found.get((f, b), (0, 0))) for b in labels]
        woe, iv = _evidence([pos for _, _, pos in rows], [total - pos for _, total, pos in rows])
        by_bin = {b: w for (b, _, _), w in zip(rows, woe)}
        rules.append((f, [(float(right[b + 1]), by_bin[b]) for b in bins], by_bin.get(-1)))
        report += [
            (f, len(bins), float(sum(iv)), labels[b], w, v, total, pos)
            for (b, total, pos), w, v in zip(rows, woe, iv)
        ]
        if -1 not in labels:
            report.append((f, len(bins), float(sum(iv)), ELSE, 0.0, 0.0, 0, 0))
    spark = df.sparkSession
    return WoeBinning(
        spark.createDataFrame(rules, RULE_SCHEMA),
        spark.createDataFrame(
            report,
            "feature string, bin_count int, feature_iv double, label string, woe double,"
            " iv double, total long, pos_count long",
        ),
    )


def _evidence(pos: Sequence[int], neg: Sequence[int]) -> tuple[list[float], list[float]]:
    """Weight of evidence and information value per bin; counts below 1 become 0.5 first."""
    p, n = ([float(c) if c >= 1 else 0.5 for c in counts] for counts in (pos, neg))
    p, n = ([c / sum(side) for c in side] for side in (p, n))
    woe = [math.log(a / b) for a, b in zip(p, n)]
    return woe, [(a - b) * w for a, b, w in zip(p, n, woe)]


def woe_substitution(df: DataFrame, rules: DataFrame | Sequence[dict]) -> DataFrame:
    """Replace features by the weight of evidence of their bin.

    A value takes the first bin whose right edge is not below it, the last bin beyond the
    last edge. A missing value takes the else bin; where the rule has none, it is an
    error. Rules for columns that are no features are ignored. Row by row, so it works on
    streaming tables too.
    """
    if isinstance(rules, DataFrame):
        # One row per feature.
        rules = [r.asDict(recursive=True) for r in rules.collect()]
    by_feature = {r["feature"]: r for r in rules}
    features = set(columns_with_role(df, FEATURE))
    out, source, searches = [], [], []
    for i, field in enumerate(df.schema.fields):
        source.append(col(field.name))
        rule = by_feature.get(field.name) if field.name in features else None
        if rule is None:
            out.append(col(field.name))
            continue
        x, number = f"__x{i}", f"__b{i}"
        source[-1] = as_double(df, field.name).alias(x)
        woes = [float(b["woe"]) for b in rule["bins"]]
        searches.append((number, x, [float(b["right"]) for b in rule["bins"]][:-1]))
        if woes:
            known = F.get(double_array(woes), F.col(number))
        else:
            known = F.raise_error(F.lit(f"the rule of {field.name} has no bins")).cast("double")
        if rule.get("else_woe") is None:
            message = f"missing value in {field.name}, and its rule has no else bin"
            absent = F.raise_error(F.lit(message)).cast("double")
        else:
            absent = F.lit(float(rule["else_woe"]))
        value = F.when(F.col(x).isNull(), absent).otherwise(known)
        out.append(value.alias(field.name, metadata=field.metadata))
    df = df.select(source)
    for number, x, edges in searches:
        df = with_bin_number(df, number, x, edges)
    return df.select(out)
