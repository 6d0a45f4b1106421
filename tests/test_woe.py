import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurekit import bin_edges, woe_binning, woe_substitution, with_roles

# Rules of the small fixture with three quantile bins: fixed values.
GOLDEN = {
    "AT": ([14.223, 22.117, 29.74], [-1.540445040947149, 0.5389965007326869, 1.2321436812926323]),
    "V": ([43.743, 54.497, 58.49], [-1.540445040947149, 0.5389965007326869, 1.2321436812926323]),
    "AP": (
        [1008.427, 1011.213, 1017.13],
        [1.0498221244986776, -1.0296194171811583, -0.33647223662121306],
    ),
    "RH": ([75.063, 85.603, 97.2], [1.2321436812926323, 0.5389965007326869, -1.540445040947149]),
}


def test_golden_rules_and_round_trip(plant):
    found = woe_binning(plant, list(GOLDEN), bin_num=3)
    rules = {r["feature"]: r for r in found.rules.collect()}
    assert list(rules) == list(GOLDEN)
    for feature, (edges, woes) in GOLDEN.items():
        assert [b["right"] for b in rules[feature]["bins"]] == edges
        assert [b["woe"] for b in rules[feature]["bins"]] == pytest.approx(woes, abs=1e-12)
        assert rules[feature]["else_woe"] is None
    out = woe_substitution(plant, found.rules)
    assert out.columns == plant.columns
    assert out.first()["AT"] == pytest.approx(-1.540445040947149)
    assert out.first()["PE"] == 480.48
    report = found.report.where("feature = 'AT'").collect()
    assert [r["total"] for r in report] == [2, 1, 2, 0]
    assert [r["pos_count"] for r in report] == [0, 1, 2, 0]
    assert report[0]["label"] == "(8.339, 14.223]" and report[-1]["label"] == "else"
    assert report[0]["feature_iv"] == pytest.approx(sum(r["iv"] for r in report))


def _expected(x, y, bins, method):
    """Straightforward computation on a small table."""
    cut = pd.qcut(x, bins, duplicates="drop") if method == "quantile" else pd.cut(x, bins)
    codes = cut.cat.codes.to_numpy()
    n_bins = len(cut.cat.categories)
    order = list(range(n_bins)) + ([-1] if (codes == -1).any() else [])
    pos = np.array([((codes == b) & (y == 1)).sum() for b in order], dtype=float)
    neg = np.array([((codes == b) & (y == 0)).sum() for b in order], dtype=float)
    pos[pos < 1], neg[neg < 1] = 0.5, 0.5
    woe = np.log((pos / pos.sum()) / (neg / neg.sum()))
    return [c.right for c in cut.cat.categories], woe


@pytest.mark.parametrize("method", ["quantile", "bucket"])
def test_against_brute_force_with_missing(spark, method):
    rng = np.random.default_rng(5)
    n = 3000
    x = np.where(rng.random(n) < 0.34, 2.0, rng.gamma(2.0, size=n) * 0.01)
    x[::11] = np.nan
    y = (rng.random(n) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": rng.normal(size=n), "y": y})).repartition(5)
    found = woe_binning(df, ["x", "z"], "y", binning_method=method, bin_num=6)
    rule = found.rules.where("feature = 'x'").first()
    right, woe = _expected(pd.Series(x), y, 6, method)
    assert [b["right"] for b in rule["bins"]] == right
    assert [b["woe"] for b in rule["bins"]] == pytest.approx(list(woe[:-1]))
    assert rule["else_woe"] == pytest.approx(woe[-1])
    exact = woe_binning(df, ["x"], "y", exact_edges=True, binning_method=method, bin_num=6)
    edges = bin_edges(df, ["x"], method, 6)["x"]
    assert [b["right"] for b in exact.rules.first()["bins"]] == edges[1:]


def test_labels_of_other_types(plant):
    for kind, positive in [("boolean", "true"), ("boolean", "1"), ("string", "1"), ("double", "1")]:
        df = with_roles(plant.withColumn("RE", F.col("RE").cast(kind)), labels=["RE"])
        rule = woe_binning(df, ["AT"], bin_num=3, positive_label=positive).rules.first()
        assert rule["bins"][0]["woe"] == pytest.approx(-1.540445040947149)
    gap = with_roles(plant.withColumn("RE", F.expr("nullif(RE, 0)")), labels=["RE"])
    assert woe_binning(gap, ["AT"], bin_num=3).report.agg(F.sum("total")).first()[0] == 3


def test_constant_feature_has_no_bins(plant):
    df = plant.withColumn("same", F.lit(1.0))
    found = woe_binning(df, ["same"], bin_num=3)
    assert found.rules.first()["bins"] == []
    assert [r["label"] for r in found.report.collect()] == ["else"]
    wide = woe_binning(df, ["same"], bin_num=2, binning_method="bucket").rules.first()
    assert len(wide["bins"]) == 2


def test_substitution_rules(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (9.0, 3), (None, 4)], "x double, id int")
    df = with_roles(df, ids=["id"])
    rule = {"feature": "x", "bins": [{"right": 1.0, "woe": -1.0}, {"right": 2.0, "woe": 5.0}]}
    other = {"feature": "id", "bins": [{"right": 1.0, "woe": 0.0}]}
    out = woe_substitution(df, [{**rule, "else_woe": 7.0}, other]).orderBy("id").collect()
    assert [r["x"] for r in out] == [-1.0, 5.0, 5.0, 7.0]
    assert [r["id"] for r in out] == [1, 2, 3, 4]
    with pytest.raises(Exception, match="no else bin"):
        woe_substitution(df, [rule]).collect()
    assert woe_substitution(df.dropna(), [rule]).count() == 3


def test_many_bins(spark):
    df = spark.range(5000).selectExpr("cast(id as double) x", "cast(id % 3 = 0 as int) y")
    found = woe_binning(df, ["x"], "y", bin_num=400)
    assert len(found.rules.first()["bins"]) == 400
    out = woe_substitution(with_roles(df, labels=["y"]), found.rules)
    assert out.select("x").distinct().count() <= 400
    assert all(math.isfinite(r["x"]) for r in out.collect())


def test_unknown_method(plant):
    with pytest.raises(ValueError):
        woe_binning(plant, ["AT"], binning_method="other")
    with pytest.raises(ValueError):
        woe_binning(plant, [])
