import pytest

from featurekit import OPERATORS, operator, table_schema, with_roles
from featurekit.params import column_list, resolve
from featurekit.schema import columns_with_role, declared_roles, spark_type, type_name


def test_defaults_and_bounds():
    assert resolve("train_test_split", {})["train_size"] == 0.75
    assert resolve("xgb_train", {"lambda": 2})["lambda"] == 2.0
    for operator_name, bad in [
        ("train_test_split", {"train_size": 1.0}),
        ("train_test_split", {"random_state": 0}),
        ("train_test_split", {"shuffle": 1}),
        ("xgb_train", {"max_depth": 17}),
        ("xgb_train", {"max_depth": 2.0}),
        ("xgb_train", {"learning_rate": 0.0}),
        ("xgb_train", {"max_bin": 254}),
        ("lgbm_train", {"num_leaves": 1}),
        ("lr_train", {"penalty": "l3"}),
        ("lr_train", {"l2_norm": 1e4}),
        ("lr_train", {"tol": float("nan")}),
        ("woe_binning", {"bin_num": 0}),
        ("biclassification_eval", {"min_item_cnt_per_bucket": 1}),
        ("prediction_bias_eval", {"bucket_method": "other"}),
        ("vif", {"unknown": 1}),
    ]:
        with pytest.raises(ValueError):
            resolve(operator_name, bad)


def test_column_list():
    assert column_list("label", "y", low=1, high=1) == ["y"]
    with pytest.raises(ValueError):
        column_list("label", ["a", "b"], high=1)
    with pytest.raises(ValueError):
        column_list("label", [], low=1)


def test_roles_survive_plans(people):
    kept = people.filter("AGE > 3").select("NAME", "AGE")
    assert columns_with_role(kept, "id") == ["NAME"]
    assert table_schema(with_roles(kept, labels=["AGE"])) == {
        "ids": ["NAME"],
        "id_types": ["str"],
        "features": [],
        "feature_types": [],
        "labels": ["AGE"],
        "label_types": ["float64"],
    }


def test_types():
    names = ["int8", "uint64", "int", "float16", "float", "bool", "str", "anything"]
    assert [type_name(spark_type(n)) for n in names] == [
        "int64", "int64", "int64", "float64", "float64", "bool", "str", "str",
    ]
    roles = declared_roles(
        {"ids": ["a"], "id_types": ["int"], "features": ["a", "b"], "feature_types": ["str", "str"]}
    )
    assert roles == {"a": ("id", "int"), "b": ("feature", "str")}


def test_registry():
    assert len(OPERATORS) == 16
    assert operator("vif") is OPERATORS["stats.vif"]
    with pytest.raises(ValueError):
        operator("nothing")
