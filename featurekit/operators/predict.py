"""Scoring a table with a trained model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import column_list, resolve
from ..schema import FEATURE, ID, LABEL, col, columns_with_role, require_columns
from .boosting import TreeModel
from .linear import LinearModel

DIGITS = 6


def predict(
    df: DataFrame,
    model: LinearModel | TreeModel,
    ids: Sequence[str] | str | None = None,
    label: Sequence[str] | str | None = None,
    col_names: Sequence[str] = (),
    **attributes,
) -> DataFrame:
    """Prediction rounded to six digits, then the id, the label and further columns.

    Binary models give the probability of class 1. The model picks its features by name.
    Id and label default to the first column with that role. Attributes: pred_name,
    save_label, label_name, save_id, id_name. One projection, no join; streaming tables
    work too.
    """
    p = resolve("predict", attributes)
    if not isinstance(model, (LinearModel, TreeModel)):
        raise ValueError(f"unsupported model type: {type(model).__name__}")
    ids = column_list("ids", ids, high=1) or columns_with_role(df, ID)
    labels = column_list("label", label, high=1) or columns_with_role(df, LABEL)
    extra = column_list("col_names", col_names)
    require_columns(df, [*model.features, *extra])

    def kept(name: str, shown: str, role: str):
        return col(name).alias(shown, metadata={**df.schema[name].metadata, "role": role})

    out = [
        F.round(model.score(df), DIGITS).alias(p["pred_name"], metadata={"role": LABEL})
    ]
    if p["save_id"]:
        if not ids:
            raise ValueError("save_id needs an id column")
        require_columns(df, ids[:1])
        out.append(kept(ids[0], p["id_name"], ID))
    if p["save_label"]:
        if not labels:
            raise ValueError("save_label needs a label column")
        require_columns(df, labels[:1])
        out.append(kept(labels[0], p["label_name"], LABEL))
    out += [kept(c, c, FEATURE) for c in extra]
    return df.select(out)


def _of_type(model, wanted: str):
    if getattr(model, "model_type", None) != wanted:
        raise ValueError(f"this is no {wanted} model: {getattr(model, 'model_type', model)!r}")
    return model


def lr_predict(df: DataFrame, model, **kwargs) -> DataFrame:
    return predict(df, _of_type(model, "lr"), **kwargs)


def xgb_predict(df: DataFrame, model, **kwargs) -> DataFrame:
    return predict(df, _of_type(model, "xgb"), **kwargs)


def lgbm_predict(df: DataFrame, model, **kwargs) -> DataFrame:
    return predict(df, _of_type(model, "lgbm"), **kwargs)
