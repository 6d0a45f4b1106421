"""Tabular feature preparation, statistics, modelling and model evaluation on Spark."""

from .operators.boosting import TreeModel, lgbm_train, xgb_train
from .operators.evaluation import (
    BiclassReport,
    biclassification_eval,
    prediction_bias_eval,
    roc_curve,
)
from .operators.join import inner_join, psi
from .operators.linear import LinearModel, lr_train
from .operators.predict import lgbm_predict, lr_predict, predict, xgb_predict
from .operators.project import feature_filter
from .operators.split import train_test_split
from .operators.stats import pearsonr, pearsonr_wide, table_statistics, vif
from .operators.woe import WoeBinning, bin_edges, woe_binning, woe_substitution
from .plans.registry import OPERATORS, operator
from .plans.task import run_task
from .schema import table_schema, with_roles

__all__ = [
    "OPERATORS",
    "BiclassReport",
    "LinearModel",
    "TreeModel",
    "WoeBinning",
    "biclassification_eval",
    "bin_edges",
    "feature_filter",
    "inner_join",
    "lgbm_predict",
    "lgbm_train",
    "lr_predict",
    "lr_train",
    "operator",
    "pearsonr",
    "pearsonr_wide",
    "predict",
    "prediction_bias_eval",
    "psi",
    "roc_curve",
    "run_task",
    "table_schema",
    "table_statistics",
    "train_test_split",
    "vif",
    "with_roles",
    "woe_binning",
    "woe_substitution",
    "xgb_predict",
    "xgb_train",
]
