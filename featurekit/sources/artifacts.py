"""Rules, reports and models in files."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trees import NODE_FIELDS
from ..operators.boosting import TreeModel
from ..operators.linear import LinearModel
from ..operators.woe import RULE_SCHEMA
from .tables import read_text, write_text

_RULE_FILE_SCHEMA = (
    "feature string, bins array<struct<right: double, woe: double>>, else_bin struct<woe: double>"
)
_NODE_SCHEMA = (
    "tree int, node int, feature int, cut double, default_left boolean, left int, right int,"
    " value double"
)


def write_rules(rules: DataFrame, path: str) -> None:
    """A JSON list of {feature, bins: [{right, woe}], else_bin?: {woe}}."""
    documents = []
    for r in rules.collect():
        rule = {"feature": r["feature"], "bins": [b.asDict() for b in r["bins"]]}
        if r["else_woe"] is not None:
            rule["else_bin"] = {"woe": r["else_woe"]}
        documents.append(rule)
    write_text(rules.sparkSession, json.dumps(documents), path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema(_RULE_FILE_SCHEMA).option("multiLine", True).json(path)
    rules = read.select("feature", "bins", F.col("else_bin.woe").alias("else_woe"))
    return rules.to(RULE_SCHEMA)


def _cell(value):
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else ("Infinity" if value > 0 else "-Infinity")
    return value


def write_report(
    spark: SparkSession, name: str, tabs: Mapping[str, DataFrame], path: str, named: bool = True
) -> None:
    """One JSON document: a tab per table, with headers and rows. ``named``: the first
    column is the row's name."""
    out = []
    for tab, df in tabs.items():
        fields = df.schema.fields
        start = 1 if named and fields[0].name in ("name", "feature") else 0
        rows = []
        for i, r in enumerate(df.collect()):
            rows.append({"name": str(r[0]) if start else str(i), "items": [_cell(v) for v in r[start:]]})
        headers = [{"name": f.name, "type": f.dataType.simpleString()} for f in fields[start:]]
        out.append({"name": tab, "headers": headers, "rows": rows})
    write_text(spark, json.dumps({"name": name, "tabs": out}), path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def write_model(spark: SparkSession, model: LinearModel | TreeModel, path: str) -> None:
    """A folder: ``meta`` (JSON) and, for trees, ``nodes`` (Parquet, one row per node)."""
    meta = {
        "model_type": model.model_type,
        "features": list(model.features),
        "logistic": model.logistic,
    }
    if isinstance(model, LinearModel):
        meta |= {"kind": "linear", "coefficients": list(model.coefficients)}
        meta["intercept"] = model.intercept
    else:
        meta |= {"kind": "trees", "base": model.base, "trees": len(model.trees)}
        rows = [
            (t, n, *(tree[f][n].item() for f in NODE_FIELDS))
            for t, tree in enumerate(model.trees)
            for n in range(len(tree["feature"]))
        ]
        nodes = spark.createDataFrame(rows, _NODE_SCHEMA)
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    write_text(spark, json.dumps(meta), f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> LinearModel | TreeModel:
    meta = json.loads(read_text(spark, f"{path}/meta"))
    features, logistic = tuple(meta["features"]), meta["logistic"]
    if meta["kind"] == "linear":
        coefficients = tuple(meta["coefficients"])
        return LinearModel(features, coefficients, meta["intercept"], logistic, meta["model_type"])
    if meta["kind"] != "trees":
        raise ValueError(f"unsupported model kind {meta['kind']!r}")
    nodes = spark.read.schema(_NODE_SCHEMA).parquet(f"{path}/nodes").toPandas()
    nodes = nodes.sort_values(["tree", "node"])
    trees = [
        {f: np.ascontiguousarray(part[f].to_numpy()) for f in NODE_FIELDS}
        for _, part in nodes.groupby("tree")
    ]
    return TreeModel(features, meta["base"], logistic, meta["model_type"], trees)
