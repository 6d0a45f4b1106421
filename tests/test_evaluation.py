import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurekit import biclassification_eval, prediction_bias_eval, roc_curve
from featurekit.functions.bins import equal_width_edges
from featurekit.operators.evaluation import BIN_COLUMNS, HEAD_FPR


@pytest.fixture(scope="module")
def scored(spark):
    """A third of all rows share one score."""
    rng = np.random.default_rng(11)
    n = 4000
    y = (rng.random(n) < 0.4).astype(float)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1).round(3)
    s = np.where(rng.random(n) < 0.33, 0.5, s)
    pdf = pd.DataFrame({"y": y, "s": s})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def _points(y, s):
    """Counts at or above every distinct score, from the highest down."""
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    ends = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp = np.cumsum(y)[ends]
    return s[ends], tp, ends + 1 - tp


def _kept(tp, fp):
    if len(tp) <= 2:
        return np.ones(len(tp), dtype=bool)
    bends = (np.diff(tp, 2) != 0) | (np.diff(fp, 2) != 0)
    return np.r_[True, bends, True]


def test_roc_curve(scored):
    pdf, df = scored
    t, tp, fp = _points(pdf["y"].to_numpy(), pdf["s"].to_numpy())
    keep = _kept(tp, fp)
    out = roc_curve(df, "y", "s")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas().sort_values("threshold", ascending=False)
    assert list(got["threshold"]) == [math.inf, *t[keep]]
    assert np.allclose(got["tpr"], [0, *(tp[keep] / tp[-1])])
    assert np.allclose(got["fpr"], [0, *(fp[keep] / fp[-1])])


def test_summary_and_head(scored):
    pdf, df = scored
    y, s = pdf["y"].to_numpy(), pdf["s"].to_numpy()
    t, tp, fp = _points(y, s)
    keep = _kept(tp, fp)
    report = biclassification_eval(df, "y", "s")
    summary = report.summary.first()
    ranks = pd.Series(s).rank().to_numpy()
    p, n = y.sum(), (1 - y).sum()
    assert summary["auc"] == pytest.approx((ranks[y == 1].sum() - p * (p + 1) / 2) / (p * n))
    assert summary["ks"] == pytest.approx((tp / p - fp / n).max())
    called = s >= 0.5
    assert summary["f1_score"] == pytest.approx(2 * y[called].sum() / (called.sum() + p))
    assert (summary["total_samples"], summary["positive_samples"]) == (len(y), p)
    thresholds = np.r_[math.inf, t[keep]]
    fprs = np.r_[0.0, fp[keep] / n]
    head = report.head.collect()
    assert [r["name"] for r in head] == [f"case_{i}" for i in range(6)]
    for r, target in zip(head, HEAD_FPR):
        at = np.abs(fprs - target).argmin()
        hit = s >= thresholds[at]
        assert r["threshold"] == thresholds[at]
        assert r["fpr"] == pytest.approx((hit & (y == 0)).sum() / n)
        assert r["recall"] == pytest.approx((hit & (y == 1)).sum() / p)
        assert r["precision"] == pytest.approx(y[hit].mean() if hit.any() else 0.0)


@pytest.mark.parametrize("part", ["eq_frequent_bins", "eq_range_bins"])
def test_bin_rows(scored, part):
    pdf, df = scored
    y, s = pdf["y"].to_numpy(), pdf["s"].to_numpy()
    if part == "eq_frequent_bins":
        edges = pd.qcut(s, 8, duplicates="drop", retbins=True)[1]
    else:
        edges = pd.cut(s, 8, retbins=True)[1]
    rows = getattr(biclassification_eval(df, "y", "s", bucket_num=8), part).collect()
    assert rows[0].__fields__[1:] == [c for c, _ in BIN_COLUMNS]
    tops = [*edges[1:-1][::-1], -math.inf]
    assert len(rows) == len(tops)
    upper, p, n = math.inf, y.sum(), (1 - y).sum()
    for i, (r, low) in enumerate(zip(rows, tops)):
        inside, above = (s >= low) & (s < upper), s >= low
        upper = low
        assert (r["name"], r["total"]) == (f"bin_{i}", inside.sum())
        assert r["positive"] == y[inside].sum() and r["negative"] == (1 - y[inside]).sum()
        tp, fp = y[above].sum(), (1 - y[above]).sum()
        want = {
            "start_value": s[inside].min(), "end_value": s[inside].max(),
            "precision": tp / (tp + fp), "recall": tp / p, "false_positive_rate": fp / n,
            "f1_score": 2 * tp / (tp + fp + p), "lift": tp / (tp + fp) * len(s) / p,
            "distribution_of_positive": y[inside].sum() / p,
            "distribution_of_negative": (1 - y[inside]).sum() / n,
            "cumulative_percent_of_positive": tp / p, "cumulative_percent_of_negative": fp / n,
            "total_cumulative_percent": (tp + fp) / len(s), "ks": tp / p - fp / n,
            "avg_score": s[inside].mean(),
        }
        for name, value in want.items():
            assert r[name] == pytest.approx(value), (i, name)
    assert sum(r["total"] for r in rows) == len(s)


def test_separable_scores_and_empty_bins(scores):
    report = biclassification_eval(scores, "y", "score", bucket_num=10, min_item_cnt_per_bucket=5)
    summary = report.summary.first()
    assert (summary["total_samples"], summary["positive_samples"]) == (165, 66)
    assert summary["auc"] == summary["ks"] == 1.0
    assert report.head.first()["threshold"] == math.inf
    empty = report.eq_range_bins.where("total = 0").first()
    assert set(empty[1:]) == {0, 0.0}
    with pytest.raises(ValueError, match="fewer than"):
        biclassification_eval(scores, "y", "score", min_item_cnt_per_bucket=12)


@pytest.mark.parametrize("label,total", [(1.0, 30), (0.0, 30)])
def test_single_class(spark, label, total):
    df = spark.range(total).select(F.lit(label).alias("y"), (F.col("id") / total).alias("s"))
    report = biclassification_eval(df, "y", "s", bucket_num=3)
    summary = report.summary.first()
    assert summary["auc"] == -1.0 and summary["ks"] is None
    assert report.head.count() == 0
    row = report.eq_range_bins.first()
    assert (row["lift"] == -1.0) == (label == 0.0)
    assert (row["false_positive_rate"] == -1.0) == (label == 1.0)


def test_constant_score(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("y"), F.lit(0.7).alias("s"))
    report = biclassification_eval(df, "y", "s", bucket_num=4)
    assert report.summary.first()["auc"] == 0.5
    assert report.eq_frequent_bins.count() == 1
    assert report.eq_range_bins.count() == 4
    assert prediction_bias_eval(df, "y", "s", bucket_method="equal_frequency").count() == 0


@pytest.mark.parametrize("method", ["equal_width", "equal_frequency"])
def test_prediction_bias(scored, method):
    pdf, df = scored
    y, s = pdf["y"].to_numpy(), pdf["s"].to_numpy()
    if method == "equal_width":
        edges = equal_width_edges(s.min(), s.max(), 5)
    else:
        edges = pd.qcut(s, 5, duplicates="drop", retbins=True)[1]
    rows = prediction_bias_eval(df, "y", "s", bucket_num=5, bucket_method=method).collect()
    assert len(rows) == len(edges) - 1
    for i, r in enumerate(rows):
        low = -math.inf if i == 0 else edges[i]
        inside = (s > low) & (s <= edges[i + 1])
        assert (r["left_endpoint"], r["right_endpoint"]) == (edges[i], edges[i + 1])
        assert r["interval"] == f"({float(edges[i])}, {float(edges[i + 1])}]"
        assert (r["left_closed"], r["right_closed"], r["is_na"]) == (False, True, False)
        assert r["avg_prediction"] == pytest.approx(s[inside].mean())
        assert r["avg_label"] == pytest.approx(y[inside].mean())
        assert r["bias"] == pytest.approx(abs(s[inside].mean() - y[inside].mean()))


def test_bias_of_the_fixture(scores):
    rows = prediction_bias_eval(scores, "y", "score").collect()
    assert len(rows) == 10
    assert [r["is_na"] for r in rows].count(True) == 2
    with pytest.raises(ValueError, match="fewer than"):
        prediction_bias_eval(scores, "y", "score", min_item_cnt_per_bucket=12)


def test_refusals(spark, scores):
    with pytest.raises(ValueError, match="label must be 0 or 1"):
        biclassification_eval(scores.withColumn("y", F.col("y") + 1), "y", "score")
    with pytest.raises(ValueError, match="miss"):
        roc_curve(scores.withColumn("score", F.expr("nullif(score, 0.1)")), "y", "score")
    with pytest.raises(ValueError, match="columns"):
        biclassification_eval(scores, ["y", "score"], "score")
    with pytest.raises(ValueError, match="empty"):
        prediction_bias_eval(scores.limit(0), "y", "score")


def test_bool_labels_and_partitions(scores):
    a = biclassification_eval(scores.withColumn("y", F.col("y") == 1), "y", "score", bucket_num=4)
    b = biclassification_eval(scores.repartition(1), "y", "score", bucket_num=4)
    for x, z in zip(a, b):
        assert x.collect() == z.collect() or np.allclose(
            x.toPandas().iloc[:, 1:].astype(float), z.toPandas().iloc[:, 1:].astype(float)
        )
