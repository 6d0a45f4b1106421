"""Operator names as users write them, and what each one is."""

from __future__ import annotations

from collections.abc import Callable

from ..operators.boosting import lgbm_train, xgb_train
from ..operators.evaluation import biclassification_eval, prediction_bias_eval
from ..operators.join import psi
from ..operators.linear import lr_train
from ..operators.predict import lgbm_predict, lr_predict, xgb_predict
from ..operators.project import feature_filter
from ..operators.split import train_test_split
from ..operators.stats import pearsonr, table_statistics, vif
from ..operators.woe import woe_binning, woe_substitution

OPERATORS: dict[str, Callable] = {
    "preprocessing.psi": psi,
    "preprocessing.feature_filter": feature_filter,
    "preprocessing.train_test_split": train_test_split,
    "stats.table_statistics": table_statistics,
    "stats.pearsonr": pearsonr,
    "stats.vif": vif,
    "feature.woe_binning": woe_binning,
    "feature.woe_substitution": woe_substitution,
    "ml.train.lr_train": lr_train,
    "ml.train.xgb_train": xgb_train,
    "ml.train.lgbm_train": lgbm_train,
    "ml.predict.lr_predict": lr_predict,
    "ml.predict.xgb_predict": xgb_predict,
    "ml.predict.lgbm_predict": lgbm_predict,
    "ml.eval.biclassification_eval": biclassification_eval,
    "ml.eval.prediction_bias_eval": prediction_bias_eval,
}

# Row-by-row operators: they take streaming tables as they are.
ROW_BY_ROW = (
    "preprocessing.feature_filter",
    "feature.woe_substitution",
    "ml.predict.lr_predict",
    "ml.predict.xgb_predict",
    "ml.predict.lgbm_predict",
)


def operator(name: str) -> Callable:
    """By full name (domain.name) or by the last part alone."""
    for full, function in OPERATORS.items():
        if name in (full, full.rsplit(".", 1)[1]):
            return function
    raise ValueError(f"no operator named {name!r}")
