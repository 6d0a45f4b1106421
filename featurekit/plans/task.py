"""Run an operator from a task description: its name, attributes, input and output files.

A task is a dict ``{component_name, <attributes>, inputs: [{data_path, schema, <column
selections>}], outputs: [{data_path, data_schema_path}]}``. Tasks chain by their files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.boosting import lgbm_train, xgb_train
from ..operators.evaluation import biclassification_eval, prediction_bias_eval
from ..operators.join import psi
from ..operators.linear import lr_train
from ..operators.predict import lgbm_predict, lr_predict, xgb_predict
from ..operators.project import feature_filter
from ..operators.split import train_test_split
from ..operators.stats import pearsonr_wide, table_statistics, vif
from ..operators.woe import woe_binning, woe_substitution
from ..schema import LABEL, columns_with_role
from ..sources.artifacts import read_model, read_rules, write_model, write_report, write_rules
from ..sources.tables import read_csv, read_parquet, write_csv, write_parquet, write_schema

_RESERVED = ("component_name", "inputs", "outputs")


def _table(spark: SparkSession, source: Mapping[str, Any], columns=None) -> DataFrame:
    path, schema = source["data_path"], source.get("schema")
    if source.get("format", "csv") == "parquet":
        return read_parquet(spark, path, schema, columns)
    if not schema:
        raise ValueError(f"the CSV input {path} needs a schema")
    return read_csv(spark, path, schema, columns)


class _Task:
    def __init__(self, spark: SparkSession, config: Mapping[str, Any]):
        self.spark, self.config = spark, config
        self.inputs, self.outputs = list(config["inputs"]), list(config["outputs"])
        self.attributes = {k: v for k, v in config.items() if k not in _RESERVED}

    def expect(self, inputs: int, outputs: int) -> None:
        if (len(self.inputs), len(self.outputs)) != (inputs, outputs):
            raise ValueError(
                f"{self.config['component_name']} takes {inputs} inputs and {outputs} outputs"
            )

    def table(self, i: int = 0, columns=None) -> DataFrame:
        return _table(self.spark, self.inputs[i], columns)

    def put(self, df: DataFrame, i: int = 0) -> None:
        target = self.outputs[i]
        lineage = [s["data_path"] for s in self.inputs]
        lineage += [p for s in self.inputs for p in s.get("lineage", ()) if p not in lineage]
        write = write_parquet if target.get("format") == "parquet" else write_csv
        write(df, target["data_path"])
        if target.get("data_schema_path"):
            write_schema(df, target["data_schema_path"], lineage)

    def report(self, name: str, tabs: dict[str, DataFrame]) -> None:
        write_report(self.spark, name, tabs, self.outputs[0]["data_path"])


def _psi(task: _Task) -> None:
    task.expect(len(task.inputs), 1)
    tables = [task.table(i) for i in range(len(task.inputs))]
    task.put(psi(*tables, keys=[s["key"] for s in task.inputs], **task.attributes))


def _feature_filter(task: _Task) -> None:
    task.expect(1, 1)
    task.put(feature_filter(task.table(), task.inputs[0]["drop_features"]))


def _train_test_split(task: _Task) -> None:
    task.expect(1, 2)
    for i, part in enumerate(train_test_split(task.table(), **task.attributes)):
        task.put(part, i)


def _statistics(operator: Callable, name: str) -> Callable:
    def run(task: _Task) -> None:
        task.expect(1, 1)
        selected = task.inputs[0].get("feature_selects", ())
        task.report(name, {name: operator(task.table(), selected)})

    return run


def _woe_binning(task: _Task) -> None:
    task.expect(1, 1)
    df = task.table()
    label = columns_with_role(df, LABEL)
    rules = woe_binning(df, task.inputs[0]["feature_selects"], label, **task.attributes).rules
    write_rules(rules, task.outputs[0]["data_path"])


def _woe_substitution(task: _Task) -> None:
    task.expect(2, 1)
    task.put(woe_substitution(task.table(), read_rules(task.spark, task.inputs[1]["data_path"])))


def _train(operator: Callable) -> Callable:
    def run(task: _Task) -> None:
        task.expect(1, 1)
        source = task.inputs[0]
        model = operator(task.table(), source["label"], source.get("ids", ()), **task.attributes)
        write_model(task.spark, model, task.outputs[0]["data_path"])

    return run


def _predict(operator: Callable) -> Callable:
    def run(task: _Task) -> None:
        task.expect(2, 1)
        source, stored = task.inputs
        model = read_model(task.spark, stored["data_path"])
        columns = {k: source[k] for k in ("ids", "label") if source.get(k)}
        task.put(operator(task.table(), model, **columns, **task.attributes))

    return run


# The names of the report tabs and tables.
def _biclassification_eval(task: _Task) -> None:
    task.expect(1, 1)
    source = task.inputs[0]
    df = task.table(columns=[*source["label"], *source["score"]])
    found = biclassification_eval(df, source["label"], source["score"], **task.attributes)
    task.report(
        "reports",
        {
            "SummaryReport": found.summary,
            "eq_frequent_bin_report": found.eq_frequent_bins,
            "eq_range_bin_report": found.eq_range_bins,
            "head_report": found.head,
        },
    )


def _prediction_bias_eval(task: _Task) -> None:
    task.expect(1, 1)
    source = task.inputs[0]
    df = task.table(columns=[*source["label"], *source["score"]])
    found = prediction_bias_eval(df, source["label"], source["score"], **task.attributes)
    task.report("Prediction Bias Report", {"Prediction Bias Table": found})


RUNNERS: dict[str, Callable[[_Task], None]] = {
    "psi": _psi,
    "feature_filter": _feature_filter,
    "train_test_split": _train_test_split,
    "table_statistics": _statistics(table_statistics, "table statistics"),
    "pearsonr": _statistics(pearsonr_wide, "corr"),
    "vif": _statistics(vif, "vif"),
    "woe_binning": _woe_binning,
    "woe_substitution": _woe_substitution,
    "lr_train": _train(lr_train),
    "xgb_train": _train(xgb_train),
    "lgbm_train": _train(lgbm_train),
    "lr_predict": _predict(lr_predict),
    "xgb_predict": _predict(xgb_predict),
    "lgbm_predict": _predict(lgbm_predict),
    "biclassification_eval": _biclassification_eval,
    "prediction_bias_eval": _prediction_bias_eval,
}


def run_task(spark: SparkSession, config: Mapping[str, Any]) -> None:
    """Read the inputs, run the operator, write the outputs."""
    name = config["component_name"].rsplit(".", 1)[-1]
    if name not in RUNNERS:
        raise ValueError(f"no operator named {name!r}")
    RUNNERS[name](_Task(spark, config))
