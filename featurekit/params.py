"""Checks of operator parameters: type, allowed values, bounds and column counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

REQUIRED = object()


@dataclass(frozen=True)
class Param:
    kind: type
    default: Any = REQUIRED
    choices: tuple = ()
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False

    def check(self, name: str, value: Any) -> Any:
        if value is None and None in self.choices:
            return value
        if self.kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, self.kind) or (
            self.kind is not bool and isinstance(value, bool)
        ):
            raise ValueError(f"{name} must be {self.kind.__name__}, got {value!r}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} must be one of {list(self.choices)}, got {value!r}")
        if self.kind in (int, float):
            too_low = self.low is not None and (
                value <= self.low if self.low_open else value < self.low
            )
            too_high = self.high is not None and (
                value >= self.high if self.high_open else value > self.high
            )
            if too_low or too_high or value != value:
                left, right = "(["[not self.low_open], ")]"[not self.high_open]
                raise ValueError(
                    f"{name}={value} is outside {left}{self.low}, {self.high}{right}"
                )
        return value


# Attribute defaults, allowed values and bounds of every operator: fixed values.
ATTRIBUTES: dict[str, dict[str, Param]] = {
    "psi": {},
    "feature_filter": {},
    "train_test_split": {
        "train_size": Param(float, 0.75, low=0, high=1, low_open=True, high_open=True),
        "fix_random": Param(bool, True),
        "random_state": Param(int, 1024, low=0, low_open=True),
        "shuffle": Param(bool, True),
    },
    "table_statistics": {},
    "pearsonr": {},
    "vif": {},
    "woe_binning": {
        "binning_method": Param(str, "quantile", choices=("quantile", "bucket")),
        "positive_label": Param(str, "1"),
        "bin_num": Param(int, 10, low=0, low_open=True),
    },
    "woe_substitution": {},
    "lr_train": {
        "max_iter": Param(int, 10, low=1, high=10000),
        "reg_type": Param(str, "logistic", choices=("logistic", "linear")),
        "l2_norm": Param(float, 1.0, low=0, high=10000, high_open=True),
        "tol": Param(float, 1e-4, low=0, high=1, low_open=True, high_open=True),
        "penalty": Param(str, "l2", choices=("l2", "l1", "elasticnet", "None", None)),
    },
    "xgb_train": {
        "num_boost_round": Param(int, 10, low=1, high=1024),
        "max_depth": Param(int, 6, low=1, high=16),
        "max_leaves": Param(int, 0, low=0, high=2**15),
        "seed": Param(int, 42, low=0),
        "learning_rate": Param(float, 0.3, low=0, high=1, low_open=True),
        "lambda": Param(float, 1.0, low=0, high=10000),
        "gamma": Param(float, 0.0, low=0, high=10000),
        "colsample_bytree": Param(float, 1.0, low=0, high=1, low_open=True),
        "base_score": Param(float, 0.5, low=0, high=1, low_open=True, high_open=True),
        "min_child_weight": Param(float, 1.0, low=0, high=1000),
        "objective": Param(
            str, "binary:logistic", choices=("binary:logistic", "reg:squarederror")
        ),
        "alpha": Param(float, 0.0, low=0, high=10000),
        "subsample": Param(float, 1.0, low=0, high=1, low_open=True),
        "max_bin": Param(int, 10, low=0, high=254, low_open=True, high_open=True),
        "tree_method": Param(str, "auto", choices=("auto", "exact", "approx", "hist")),
        "booster": Param(str, "gbtree", choices=("gbtree", "gblinear", "dart")),
    },
    "lgbm_train": {
        "n_estimators": Param(int, 10, low=1, high=1024),
        "objective": Param(str, "binary", choices=("binary", "regression")),
        "boosting_type": Param(str, "gbdt", choices=("gbdt", "rf", "dart")),
        "learning_rate": Param(float, 0.1, low=0, high=1, low_open=True),
        "num_leaves": Param(int, 31, low=2, high=1024),
    },
    "predict": {
        "pred_name": Param(str, "pred"),
        "save_label": Param(bool, False),
        "label_name": Param(str, "label"),
        "save_id": Param(bool, False),
        "id_name": Param(str, "id"),
    },
    "biclassification_eval": {
        "bucket_num": Param(int, 10, low=1),
        "min_item_cnt_per_bucket": Param(int, 2, low=2),
    },
    "prediction_bias_eval": {
        "bucket_num": Param(int, 10, low=1),
        "min_item_cnt_per_bucket": Param(int, 2, low=2),
        "bucket_method": Param(
            str, "equal_width", choices=("equal_width", "equal_frequency")
        ),
    },
}


def resolve(operator: str, given: dict[str, Any]) -> dict[str, Any]:
    """Given attributes checked, the others at their defaults; unknown names are errors."""
    specs = ATTRIBUTES[operator]
    unknown = sorted(set(given) - set(specs))
    if unknown:
        raise ValueError(f"{operator} has no attribute {unknown}")
    out = {}
    for name, spec in specs.items():
        if name in given:
            out[name] = spec.check(name, given[name])
        elif spec.default is REQUIRED:
            raise ValueError(f"{operator} needs the attribute {name}")
        else:
            out[name] = spec.default
    return out


def column_list(
    name: str, value: str | Sequence[str] | None, low: int = 0, high: int | None = None
) -> list[str]:
    """A column selection as a list, with its length checked."""
    columns = [value] if isinstance(value, str) else list(value or ())
    if any(not isinstance(c, str) for c in columns):
        raise ValueError(f"{name} must be column names, got {columns!r}")
    if len(columns) < low or (high is not None and len(columns) > high):
        raise ValueError(
            f"{name} needs between {low} and {high if high is not None else 'any number of'}"
            f" columns, got {len(columns)}"
        )
    return columns
