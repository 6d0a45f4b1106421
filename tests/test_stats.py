import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurekit import pearsonr, pearsonr_wide, table_statistics, vif
from featurekit.functions.quantiles import exact_quantiles
from featurekit.operators import stats


def _values(df):
    return {r["feature"]: r for r in df.collect()}


def test_table_statistics_equals_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({f"c{i}": rng.normal(i, 1 + i, 400) for i in range(18)})
    pdf.loc[:30, "c3"] = np.nan
    pdf["same"] = 4.2
    got = _values(table_statistics(spark.createDataFrame(pdf).repartition(4)))
    want = {
        "min": pdf.min(), "max": pdf.max(), "mean": pdf.mean(), "var(variance)": pdf.var(),
        "std(standard deviation)": pdf.std(), "sem(standard error)": pdf.sem(), "skew": pdf.skew(),
        "kurtosis": pdf.kurtosis(), "moment_3": pdf.pow(3).mean(), "sum_4": pdf.pow(4).sum(),
        "central_moment_2": (pdf - pdf.mean()).pow(2).mean(),
        "central_moment_3": (pdf - pdf.mean()).pow(3).mean(),
        "central_moment_4": (pdf - pdf.mean()).pow(4).mean(),
    }
    for name, column in want.items():
        for f in pdf:
            assert math.isclose(got[f][name], column[f], rel_tol=1e-9, abs_tol=1e-9), (name, f)
    for f in pdf:
        quartiles = [got[f][c] for c in stats.STATISTICS[9:12]]
        assert quartiles == list(pdf[f].quantile([0.25, 0.5, 0.75])), f
    assert got["c3"]["count_na(NA count)"] == 31
    assert got["c3"]["na_ratio"] == 31 / 400


def test_table_statistics_kinds(people):
    got = _values(table_statistics(people.withColumn("flag", F.col("AGE") > 4)))
    assert list(got) == ["AGE", "ADDRESS", "SALARY", "flag"]
    assert [got[f]["datatype"] for f in got] == ["float64", "str", "float64", "bool"]
    assert got["AGE"]["total_count"] == got["AGE"]["count(non-NA count)"] == 4
    assert got["ADDRESS"]["min"] is None and got["flag"]["mean"] is None


def test_table_statistics_few_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, empty double")
    got = _values(table_statistics(df))
    assert got["x"]["skew"] is None and got["x"]["var(variance)"] == 0.5
    assert got["empty"]["mean"] is None and got["empty"]["count_na(NA count)"] == 2
    one = _values(table_statistics(df.limit(1)))
    assert one["x"]["var(variance)"] is None


def test_pearsonr_and_vif_goldens(people):
    r = {(x["feature_a"], x["feature_b"]): x["r"] for x in pearsonr(people).collect()}
    assert len(r) == 4
    assert r["AGE", "SALARY"] == pytest.approx(0.8728716, abs=1e-6)
    assert r["AGE", "AGE"] == 1.0
    wide = pearsonr_wide(people)
    assert wide.columns == ["feature", "AGE", "SALARY"]
    assert wide.first()["SALARY"] == r["AGE", "SALARY"]
    found = {x["feature"]: x["vif"] for x in vif(people).collect()}
    assert found["AGE"] == pytest.approx(4.2, abs=1e-6)
    assert all(v >= 1 for v in found.values())


def test_missing_cells_are_refused(people):
    gap = people.withColumn("ADDRESS", F.expr("nullif(ADDRESS, 'west')"))
    for operator in (pearsonr, vif):
        with pytest.raises(ValueError, match="missing"):
            operator(gap)
        assert operator(gap, ["AGE", "SALARY"]).count() > 0


def test_constant_and_collinear_columns(people):
    df = people.withColumn("same", F.lit(2.5)).withColumn("flag", F.col("AGE") > 4)
    r = {(x["feature_a"], x["feature_b"]): x["r"] for x in pearsonr(df).collect()}
    assert r["same", "same"] == r["same", "AGE"] == 999.0
    assert not any("flag" in pair for pair in r)
    found = {x["feature"]: x["vif"] for x in vif(df).collect()}
    assert found["same"] == -1.0 and found["AGE"] == pytest.approx(4.2)
    found = {x["feature"]: x["vif"] for x in vif(people.withColumn("AGE2", 3 * F.col("AGE") + 1)).collect()}
    assert found["AGE"] == found["AGE2"] == math.inf


def test_many_columns_use_vectors(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 12)) * 1e-8, columns=[f"c.{i}" for i in range(12)])
    pdf["c.1"] += pdf["c.0"]
    pdf["same"] = 1.0
    df = spark.createDataFrame(pdf)
    wide = pearsonr_wide(df).toPandas().set_index("feature")
    want = pdf.corr().fillna(999.0)
    assert np.allclose(wide.to_numpy(), want.to_numpy(), atol=1e-9)


def test_many_columns_share_their_scans(spark):
    """Hundreds of columns in a handful of jobs, with the results of few columns."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({f"c{i}": np.round(rng.normal(size=400), i % 4) for i in range(300)})
    pdf.loc[:50, "c7"], pdf["c8"], pdf["c9"] = np.nan, np.nan, 3.0
    df = spark.createDataFrame(pdf).withColumn("word", F.expr("nullif(CAST(c9 AS STRING), 'x')")).repartition(5)
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.adaptive.enabled", False)  # stages would count as jobs
    spark.sparkContext.setJobGroup("wide", "wide")
    try:
        found = table_statistics(df)
        jobs = len(tracker.getJobIdsForGroup("wide"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext.setJobGroup("other", "other")
    assert jobs <= 5
    got = found.toPandas().set_index("feature")
    assert len(got) == 301 and got.loc["word", "count(non-NA count)"] == 400
    few = [f"c{i}" for i in (0, 1, 2, 3, 7, 8, 9, 299)]
    want = table_statistics(df, few).toPandas().set_index("feature")
    for name in few:
        for column in want.columns:
            a, b = got.loc[name, column], want.loc[name, column]
            assert a == b or (pd.isna(a) and pd.isna(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-12), (name, column)
    for q, column in ((0.25, "q1(first quartile)"), (0.5, "q2(second quartile, median)")):
        assert got.loc["c3", column] == pdf["c3"].quantile(q)
    edges = exact_quantiles(df, [c for c in pdf.columns if c != "c8"], [0.1, 0.9])
    assert edges["c299"] == list(pdf["c299"].quantile([0.1, 0.9]))
    assert table_statistics(df.limit(0)).count() == 301


def test_correlations_in_blocks_equal_those_in_one(spark, monkeypatch):
    from featurekit.functions import cross_products

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 14)) @ rng.normal(size=(14, 14)) + 1e6
    pdf = pd.DataFrame({f"c{i}": x[:, i] for i in range(14)})
    pdf["flat"], pdf["tiny"] = 2.0, rng.normal(size=300) * 1e-9
    df = spark.createDataFrame(pdf).repartition(3)
    want = {(r["feature_a"], r["feature_b"]): r["r"] for r in pearsonr(df).collect()}
    factors = {r["feature"]: r["vif"] for r in vif(df.drop("flat")).collect()}
    for size in (4, 5, 15):
        monkeypatch.setattr(cross_products, "BLOCK", size)
        got = {(r["feature_a"], r["feature_b"]): r["r"] for r in pearsonr(df).collect()}
        assert got.keys() == want.keys() and len(got) == 256
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        assert got["c3", "c3"] == 1.0 and got["flat", "c1"] == got["flat", "flat"] == 999.0
    again = {r["feature"]: r["vif"] for r in vif(df.drop("flat")).collect()}
    assert all(again[k] == pytest.approx(factors[k], rel=1e-6) for k in factors)
    with pytest.raises(ValueError, match="missing"):
        pearsonr(df.withColumn("c0", F.expr("nullif(flat, 2)")))
