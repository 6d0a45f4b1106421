import csv
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurekit import (
    TreeModel,
    lgbm_train,
    lr_train,
    predict,
    run_task,
    table_schema,
    with_roles,
    woe_binning,
    woe_substitution,
)
from featurekit.sources import split_csv
from featurekit.sources.artifacts import (
    read_model,
    read_report,
    read_rules,
    write_model,
    write_rules,
)
from featurekit.sources.tables import read_csv, read_parquet, read_schema, write_csv, write_parquet
from featurekit.streaming import apply_to_stream

SCHEMA = {
    "ids": ["id"],
    "id_types": ["int"],
    "features": ["mean radius", "name", "flag"],
    "feature_types": ["float", "str", "bool"],
}


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_csv_reader(spark, tmp_path, delimiter):
    lines = ["id,mean radius,name,flag", "1,1.5,NA,True", "2,null,,False", "3,-nan,x y,true"]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines).replace(",", delimiter) + "\n")
    df = read_csv(spark, str(path), SCHEMA)
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, None, True),
        (2, None, None, False),
        (3, None, "x y", True),
    ]
    assert table_schema(df)["ids"] == ["id"]
    assert table_schema(df)["feature_types"] == ["float64", "str", "bool"]
    pruned = read_csv(spark, str(path), SCHEMA, columns=["name", "id"])
    assert pruned.columns == ["id", "name"]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,name:string>" in plan


def test_csv_refusals(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,other\n1,2\n")
    with pytest.raises(ValueError, match="other"):
        read_csv(spark, str(path), SCHEMA)
    path.write_text("id,name\nx,y\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, str(path), SCHEMA).collect()


def test_parquet_keeps_roles(spark, people, tmp_path):
    path = str(tmp_path / "p")
    write_parquet(people, path)
    assert table_schema(read_parquet(spark, path)) == table_schema(people)
    plan = read_parquet(spark, path, columns=["AGE"]).filter("AGE > 3")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<AGE:double>" in text and "GreaterThan(AGE,3.0)" in text


def test_rules_file(spark, plant, tmp_path):
    gap = plant.withColumn("AT", F.expr("nullif(AT, 8.34)"))
    rules = woe_binning(gap, ["AT", "V"], bin_num=2).rules
    write_rules(rules, str(tmp_path / "rules"))
    back = read_rules(spark, str(tmp_path / "rules"))
    assert sorted(back.collect()) == sorted(rules.collect())
    document = json.loads(next((tmp_path / "rules").glob("part*")).read_text())
    assert [("else_bin" in r) for r in document] == [True, False]
    assert woe_substitution(gap, back).collect() == woe_substitution(gap, rules).collect()


def test_model_files(spark, tmp_path):
    df = spark.range(400).selectExpr(
        "cast(id % 17 as double) as x", "id % 5 as z", "cast(id % 17 + id % 5 > 9 as int) as y"
    )
    df = with_roles(df, labels=["y"])
    for name, model in [
        ("linear", lr_train(df, "y")),
        ("trees", lgbm_train(df, "y", n_estimators=3, num_leaves=4)),
    ]:
        write_model(spark, model, str(tmp_path / name))
        back = read_model(spark, str(tmp_path / name))
        assert type(back) is type(model)
        assert predict(df, back).collect() == predict(df, model).collect()
        assert isinstance(back, TreeModel) == (name == "trees")


def test_infinite_cut_survives_files(spark, tmp_path):
    """Known against missing values is a cut at infinity."""
    rows = [(1.0, 0.0)] * 40 + [(None, 1.0)] * 40
    df = with_roles(spark.createDataFrame(rows, "x double, y double"), labels=["y"])
    model = lgbm_train(df, "y", n_estimators=1, num_leaves=2)
    assert model.trees[0]["cut"][0] == math.inf
    write_model(spark, model, str(tmp_path / "m"))
    back = read_model(spark, str(tmp_path / "m"))
    assert predict(df, back).distinct().count() == 2
    assert np.isinf(back.trees[0]["cut"][0])


def test_chain_of_tasks(spark, tmp_path):
    """Join two halves, split, train, score, evaluate: every step from files to files."""
    n = 569
    left = spark.range(n).selectExpr("id", "cast(id % 23 as double) as `mean radius`")
    right = spark.range(n).selectExpr(
        "id", "cast(id % 7 as double) as symmetry", "(id % 23) + (id % 7) > 14 as target"
    )
    write_csv(left, str(tmp_path / "left"))
    write_csv(right, str(tmp_path / "right"))

    def at(name):
        return str(tmp_path / name)

    def output(name):
        return {"data_path": at(name), "data_schema_path": at(name + ".schema")}

    half = {"ids": ["id"], "id_types": ["int"]}
    run_task(
        spark,
        {
            "component_name": "psi",
            "inputs": [
                {
                    "data_path": at("left"),
                    "schema": {**half, "features": ["mean radius"], "feature_types": ["float"]},
                    "key": ["id"],
                },
                {
                    "data_path": at("right"),
                    "schema": {
                        **half, "features": ["symmetry"], "feature_types": ["float"],
                        "labels": ["target"], "label_types": ["bool"],
                    },
                    "key": ["id"],
                },
            ],
            "outputs": [output("joined")],
        },
    )
    schema = read_schema(spark, at("joined.schema"))
    assert schema["ids"] == ["id"] and schema["label_types"] == ["bool"]
    assert schema["lineage"] == [at("left"), at("right")]
    joined = {"data_path": at("joined"), "schema": schema, "lineage": schema["lineage"]}
    assert read_csv(spark, at("joined"), schema).count() == n
    run_task(
        spark,
        {
            "component_name": "train_test_split", "train_size": 0.8, "random_state": 3,
            "inputs": [joined], "outputs": [output("train"), output("test")],
        },
    )
    train = {"data_path": at("train"), "schema": schema}
    test = {"data_path": at("test"), "schema": schema}
    assert read_csv(spark, at("train"), schema).count() == 455
    assert at("left") in read_schema(spark, at("test.schema"))["lineage"]
    training = {
        "lr": {"component_name": "lr_train", "max_iter": 50},
        "xgb": {"component_name": "xgb_train", "num_boost_round": 2, "max_depth": 2, "lambda": 1},
        "lgbm": {"component_name": "lgbm_train", "n_estimators": 2, "num_leaves": 4},
    }
    for kind, config in training.items():
        run_task(
            spark,
            {
                **config,
                "inputs": [{**train, "ids": ["id"], "label": ["target"]}],
                "outputs": [{"data_path": at(kind)}],
            },
        )
        run_task(
            spark,
            {
                "component_name": f"{kind}_predict", "pred_name": "score", "save_id": True,
                "save_label": True, "col_names": ["symmetry"],
                "inputs": [{**test, "ids": [], "label": []}, {"data_path": at(kind)}],
                "outputs": [output(f"{kind}.scores")],
            },
        )
        found = read_schema(spark, at(f"{kind}.scores.schema"))
        assert found["labels"] == ["score", "label"] and found["features"] == ["symmetry"]
    scores = {
        "data_path": at("lr.scores"), "schema": read_schema(spark, at("lr.scores.schema")),
        "label": ["label"], "score": ["score"],
    }
    for name, tabs in [("biclassification_eval", 4), ("prediction_bias_eval", 1)]:
        run_task(
            spark,
            {
                "component_name": name, "bucket_num": 2,
                "inputs": [scores], "outputs": [{"data_path": at(name)}],
            },
        )
        report = read_report(spark, at(name))
        assert len(report["tabs"]) == tabs
        assert all(len(r["items"]) == len(t["headers"]) for t in report["tabs"] for r in t["rows"])
    for name in ("table_statistics", "pearsonr", "vif"):
        run_task(
            spark,
            {"component_name": name, "inputs": [joined], "outputs": [{"data_path": at(name)}]},
        )
        rows = read_report(spark, at(name))["tabs"][0]["rows"]
        assert [r["name"] for r in rows] == ["mean radius", "symmetry"]
    run_task(
        spark,
        {
            "component_name": "feature.woe_binning", "bin_num": 3,
            "inputs": [{**train, "feature_selects": ["mean radius"]}],
            "outputs": [{"data_path": at("rules")}],
        },
    )
    run_task(
        spark,
        {
            "component_name": "woe_substitution",
            "inputs": [test, {"data_path": at("rules")}], "outputs": [output("substituted")],
        },
    )
    assert read_csv(spark, at("substituted"), schema).select("mean radius").distinct().count() == 3
    run_task(
        spark,
        {
            "component_name": "feature_filter",
            "inputs": [{**joined, "drop_features": ["symmetry"]}], "outputs": [output("filtered")],
        },
    )
    assert "symmetry" not in read_schema(spark, at("filtered.schema"))["features"]


def test_task_refusals(spark):
    with pytest.raises(ValueError, match="no operator"):
        run_task(spark, {"component_name": "other", "inputs": [], "outputs": []})
    with pytest.raises(ValueError, match="1 inputs"):
        run_task(spark, {"component_name": "vif", "inputs": [], "outputs": []})


def test_row_by_row_operators_on_streams(spark, plant, tmp_path):
    path = str(tmp_path / "in")
    write_parquet(plant, path)
    rules = woe_binning(plant, ["AT"], bin_num=3).rules
    model = lr_train(plant.select("AT", "V", "RE"), "RE")

    def run(name, *args, **kwargs):
        stream = with_roles(spark.readStream.schema(plant.schema).parquet(path), labels=["RE"])
        out = apply_to_stream(name, stream, *args, **kwargs)
        sink = f"sink_{name}"
        query = out.writeStream.format("memory").queryName(sink).trigger(availableNow=True).start()
        query.awaitTermination(60)
        query.stop()
        return sorted(tuple(r) for r in spark.table(sink).collect())

    want = sorted(tuple(r) for r in woe_substitution(plant, rules).collect())
    assert run("woe_substitution", rules) == want
    want = sorted(tuple(r) for r in predict(plant, model, save_label=True).collect())
    assert run("lr_predict", model, save_label=True) == want
    assert len(run("feature_filter", ["AT"])) == 5
    with pytest.raises(ValueError, match="whole table"):
        apply_to_stream("vif", plant)


def test_csv_cells_with_quotes_and_line_breaks(spark, tmp_path):
    from featurekit.sources.tables import read_csv, write_csv

    cells = ['plain', '{"k": "v, w"}', 'two\nlines', 'back\\slash\\', ' spaced ', '""', 'a,b;c', '"', None]
    df = spark.createDataFrame([(i, c, float(i)) for i, c in enumerate(cells)], "id long, info string, x double")
    schema = {"ids": ["id"], "features": ["info", "x"], "labels": [], "id_types": ["int64"], "feature_types": ["str", "float64"], "label_types": []}
    path = str(tmp_path / "t")
    write_csv(df.coalesce(1), path)
    assert sorted(map(tuple, read_csv(spark, path, schema).collect())) == sorted(map(tuple, df.collect()))
    (part,) = (tmp_path / "t").glob("part-*.csv")
    assert list(pd.read_csv(part, keep_default_na=True)["info"].dropna()) == [c for c in cells if c is not None]
    other = tmp_path / "other.csv"
    other.write_text('id,info,x\n1,"{""k"": ""v, w""}",2.5\n2,plain,3.5\n')
    got = read_csv(spark, str(other), schema, line_breaks=False)
    assert [tuple(r) for r in got.collect()] == [(1, '{"k": "v, w"}', 2.5), (2, "plain", 3.5)]


def _odd_cells(n):
    rng = random.Random(n)
    cells = ["", "plain", 'say "no"', "a,b", "line\nbreak", "\n\n", '"', '""', "x\r\ny", " space ", "é\n,\"", "1.5", "'", "end\r"]
    return [(i, rng.choice(cells) * rng.choice([1, 1, 3]), rng.choice(cells), rng.random()) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_csv_files_are_split_like_whole_ones(spark, tmp_path, monkeypatch, end):
    """Records that cross splits, cells longer than a split, several files."""
    rows = _odd_cells(900)
    rows[100] = (100, "long\n\"cell\"," * 3000, "x", 0.5)
    for k, part in enumerate((rows[:700], rows[700:701], rows[701:])):
        with open(tmp_path / f"part-{k}.csv", "w", newline="", encoding="utf-8") as f:
            writer = csv.writer(f, lineterminator=end)
            writer.writerow(["id", "first,name", "second", "score"])
            writer.writerows(part)
    schema = {"ids": ["id"], "id_types": ["int64"], "features": ["first,name", "second", "score"], "feature_types": ["str", "str", "float64"]}
    whole = read_csv(spark, str(tmp_path), schema, split=False)
    want = sorted(map(tuple, whole.collect()), key=str)
    monkeypatch.setattr(split_csv, "SPLIT_BYTES", 0)
    for size in (1500, 40_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        try:
            got = read_csv(spark, str(tmp_path), schema)
            assert sorted(map(tuple, got.collect()), key=str) == want
            assert got.rdd.getNumPartitions() > 4 and len(want) == len(rows)
            assert sorted(map(tuple, read_csv(spark, str(tmp_path), schema, columns=["second"]).collect()), key=str) == sorted([(r[2],) for r in want], key=str)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert table_schema(got) == table_schema(whole)


def test_split_csv_with_quotes_inside_unquoted_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split_csv, "SPLIT_BYTES", 0)
    path = tmp_path / "odd.csv"
    path.write_text('id,size\n1,5" pipe\n2,plain\n')
    schema = {"ids": ["id"], "id_types": ["int64"], "features": ["size"], "feature_types": ["str"]}
    assert sorted(map(tuple, read_csv(spark, str(path), schema).collect())) == [(1, '5" pipe'), (2, "plain")]
    path.write_text('id,size\n1,5"\n2,plain\n3,6"\n')
    with pytest.raises(Exception, match="split=False"):
        read_csv(spark, str(path), schema).collect()
    path.write_text('size,id\n1,5\n')
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "a.csv").write_text("id,size\n1,x\n")
    (tmp_path / "dir" / "b.csv").write_text("size,id\nx,1\n")
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, str(tmp_path / "dir"), schema)
