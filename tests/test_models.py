import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurekit import (
    lgbm_predict,
    lgbm_train,
    lr_predict,
    lr_train,
    predict,
    table_schema,
    with_roles,
    xgb_predict,
    xgb_train,
)
from featurekit.functions.trees import best_cuts, sampled
from featurekit.operators import boosting, growth


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n = 1500
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n) * 3 + 1})
    pdf["c"] = rng.integers(0, 6, n).astype(float)
    margin = pdf["a"] * 1.5 - pdf["b"] * 0.4 + (pdf["c"] > 3) * 1.2
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(-margin))).astype(int)
    pdf["v"] = margin + rng.normal(size=n) * 0.1
    df = with_roles(spark.createDataFrame(pdf).repartition(4), ids=["id"], labels=["y", "v"])
    return pdf, df


def _newton(x, y, l2):
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty
        w -= np.linalg.solve(hessian, x.T @ (p - y) + penalty @ w)
    return w


@pytest.mark.parametrize("l2", [0.0, 1.0, 50.0])
def test_logistic_l2_against_newton(data, l2):
    pdf, df = data
    model = lr_train(df, "y", l2_norm=l2, max_iter=200, tol=1e-10)
    assert model.features == ("a", "b", "c")
    want = _newton(pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy(), l2)
    assert [model.intercept, *model.coefficients] == pytest.approx(list(want), abs=1e-5)


def test_logistic_penalties(data):
    _, df = data
    free = lr_train(df, "y", penalty="None", max_iter=100)
    lasso = lr_train(df, "y", penalty="l1", l2_norm=2000.0, max_iter=100)
    mixed = lr_train(df, "y", penalty="elasticnet", l2_norm=100.0, max_iter=100)
    assert set(lasso.coefficients) == {0.0}
    assert abs(mixed.coefficients[0]) < abs(free.coefficients[0])


@pytest.mark.parametrize("alpha", [0.0, 10.0, 5000.0])
def test_ridge_against_closed_form(data, alpha):
    pdf, df = data
    x = pdf[["a", "b", "c"]].to_numpy()
    x0, y = x - x.mean(axis=0), pdf["v"].to_numpy()
    want = np.linalg.solve(x0.T @ x0 + alpha * np.eye(3), x0.T @ y)
    model = lr_train(df, "v", reg_type="linear", l2_norm=alpha)
    assert list(model.coefficients) == pytest.approx(list(want), rel=1e-7)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ want, rel=1e-7)


def test_linear_booster_penalties(data):
    pdf, df = data
    model = xgb_train(df, "v", objective="reg:squarederror", booster="gblinear",
                      num_boost_round=100, alpha=0.0, **{"lambda": 0.5})
    x = pdf[["a", "b", "c"]].to_numpy()
    x0, y = x - x.mean(axis=0), pdf["v"].to_numpy()
    n = len(y)
    want = np.linalg.solve(x0.T @ x0 / n + 0.5 * np.eye(3), x0.T @ (y - y.mean()) / n)
    assert list(model.coefficients) == pytest.approx(list(want), rel=1e-6)
    strong = xgb_train(df, "v", objective="reg:squarederror", booster="gblinear",
                       num_boost_round=100, alpha=100.0)
    assert set(strong.coefficients) == {0.0}


def test_constant_and_bad_labels(spark, data):
    _, df = data
    flat = df.withColumn("v", F.lit(3.0))
    model = lr_train(with_roles(flat, labels=["v"]), "v", reg_type="linear")
    assert set(model.coefficients) == {0.0} and model.intercept == 3.0
    words = with_roles(df.withColumn("y", F.when(F.col("id") > 5, "x").otherwise("1")), labels=["y"])
    with pytest.raises(ValueError, match="labels"):
        lr_train(words, "y")
    numbers = with_roles(df.withColumn("y", F.col("y").cast("string")), labels=["y"])
    assert lr_train(numbers, "y").coefficients == lr_train(df, "y").coefficients
    with pytest.raises(ValueError, match="missing"):
        lr_train(df.withColumn("a", F.expr("nullif(c, 2)")), "y")
    with pytest.raises(ValueError, match="two classes"):
        lr_train(with_roles(df.withColumn("y", F.lit(1)), labels=["y"]), "y")
    with pytest.raises(Exception, match="more than two classes"):
        lr_train(with_roles(df.withColumn("y", F.col("id") % 3), labels=["y"]), "y")
    with pytest.raises(ValueError, match="numbers"):
        lr_train(df.withColumn("text", F.lit("t")), "y")


# --- trees ---------------------------------------------------------------------------------


def _tree(x, g, h, cuts, depth, l2, rate):
    """Recursive exact search over the given cuts: prediction per row."""

    def strength(mask):
        return g[mask].sum() ** 2 / (h[mask].sum() + l2)

    out = np.zeros(len(g))

    def grow(mask, level):
        best = (1e-6, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in cuts[f]:
                    left, right = mask & (x[:, f] <= cut), mask & (x[:, f] > cut)
                    if h[left].sum() < 1 or h[right].sum() < 1:
                        continue
                    gain = strength(left) + strength(right) - strength(mask)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1] is None:
            out[mask] = -rate * g[mask].sum() / (h[mask].sum() + l2)
        else:
            for side in best[1]:
                grow(side, level + 1)

    grow(np.ones(len(g), dtype=bool), 0)
    return out


@pytest.mark.parametrize("objective", ["reg:squarederror", "binary:logistic"])
def test_level_wise_against_brute_force(data, objective):
    pdf, df = data
    logistic = objective == "binary:logistic"
    label = "y" if logistic else "v"
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf[label].to_numpy().astype(float)
    model = xgb_train(df, label, objective=objective, num_boost_round=4, max_depth=3)
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, 10))))[:-1] for f in range(3)]
    margin = np.full(len(y), 0.0 if logistic else 0.5)
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin)) if logistic else margin
        h = p * (1 - p) if logistic else np.ones_like(y)
        margin = margin + _tree(x, p - y, h, cuts, 3, 1.0, 0.3)
    want = 1 / (1 + np.exp(-margin)) if logistic else margin
    got = xgb_predict(df, model, save_id=True).toPandas().sort_values("id")["pred"]
    assert np.allclose(got, want, atol=2e-6)


def test_scoring_paths_agree_and_missing_values(spark, data, monkeypatch):
    _, df = data
    gaps = df.withColumns(
        {"a": F.expr("IF(id % 7 = 0, NULL, a)"), "b": F.expr("IF(id % 5 = 0, double('NaN'), b)")}
    )
    model = xgb_train(gaps, "y", num_boost_round=4, max_depth=4, subsample=0.8, colsample_bytree=0.7)
    compiled = xgb_predict(gaps, model, save_id=True).orderBy("id").toPandas()
    monkeypatch.setattr(boosting, "EXPRESSION_NODES", 0)
    batched = xgb_predict(gaps, model, save_id=True).orderBy("id").toPandas()
    assert np.allclose(compiled["pred"], batched["pred"], atol=1e-6)
    assert compiled["pred"].between(0, 1).all()


def test_missing_goes_to_the_better_side(spark):
    rows = [(float(i % 10), 0.0) for i in range(100)] + [(None, 5.0)] * 50
    df = with_roles(spark.createDataFrame(rows, "x double, y double"), labels=["y"])
    model = xgb_train(df, "y", objective="reg:squarederror", num_boost_round=1, max_depth=1,
                      learning_rate=1.0, **{"lambda": 0.0})
    got = xgb_predict(df, model, save_label=True).distinct().collect()
    assert {(r["pred"], r["label"]) for r in got} == {(0.0, 0.0), (5.0, 5.0)}


def test_limits_and_penalties(data):
    _, df = data

    def leaves(model):
        return [int((t["feature"] < 0).sum()) for t in model.trees]

    assert leaves(xgb_train(df, "y", num_boost_round=2, max_leaves=3)) == [3, 3]
    assert leaves(xgb_train(df, "y", num_boost_round=1, gamma=9000.0)) == [1]
    assert leaves(xgb_train(df, "y", num_boost_round=1, min_child_weight=1000.0)) == [1]
    assert leaves(lgbm_train(df, "y", n_estimators=2, num_leaves=5)) == [5, 5]
    shrunk = xgb_train(df, "y", num_boost_round=1, max_depth=1, alpha=1e4)
    assert set(shrunk.trees[0]["value"]) == {0.0}


def test_exact_cuts(data):
    pdf, df = data
    few = df.drop("a", "b")
    model = xgb_train(few, "v", objective="reg:squarederror", tree_method="exact",
                      num_boost_round=1, max_depth=6, learning_rate=1.0, **{"lambda": 0.0})
    got = xgb_predict(few, model, save_id=True).toPandas().sort_values("id")["pred"]
    assert np.allclose(got, pdf.groupby("c")["v"].transform("mean"), atol=1e-5)


def test_leaf_wise_takes_the_greatest_gain_first(data):
    """A depth-first check on the sums: with one split the leaf-wise and level-wise trees
    agree, and more leaves never raise the training error."""
    pdf, df = data
    errors = []
    for leaves in (2, 4, 9):
        model = lgbm_train(df, "v", objective="regression", n_estimators=1, num_leaves=leaves,
                           learning_rate=1.0)
        got = lgbm_predict(df, model, save_id=True).toPandas().sort_values("id")["pred"]
        errors.append(float(((got.to_numpy() - pdf["v"]) ** 2).mean()))
    assert errors == sorted(errors, reverse=True)
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["v"].to_numpy()
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, 255))))[:-1] for f in range(3)]
    want = _tree(x, y.mean() - y, np.ones_like(y), cuts, 1, 0.0, 1.0)
    assert errors[0] == pytest.approx(float(((y.mean() + want - y) ** 2).mean()), rel=1e-5)


@pytest.mark.parametrize("kind", ["gbdt", "dart", "rf"])
def test_leaf_wise_kinds_learn(data, kind):
    pdf, df = data
    model = lgbm_train(df, "y", n_estimators=4, num_leaves=6, boosting_type=kind, learning_rate=0.3)
    got = lgbm_predict(df, model, save_id=True).toPandas().sort_values("id")["pred"]
    ranks, y = got.rank().to_numpy(), pdf["y"].to_numpy()
    p, n = y.sum(), (1 - y).sum()
    assert (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * n) > 0.8
    again = lgbm_train(df.repartition(3), "y", n_estimators=1, num_leaves=4)
    same = lgbm_train(df, "y", n_estimators=1, num_leaves=4)
    assert list(again.trees[0]["cut"]) == list(same.trees[0]["cut"])


def test_margins_survive_table_rewrites(data, monkeypatch):
    _, df = data
    want = xgb_train(df, "y", num_boost_round=4, max_depth=2)
    monkeypatch.setattr(boosting, "TREES_PER_TABLE", 2)
    monkeypatch.setattr(growth, "CELLS_PER_JOB", 40)
    got = xgb_train(df, "y", num_boost_round=4, max_depth=2)
    for a, b in zip(want.trees, got.trees):
        assert list(a["feature"]) == list(b["feature"])
        assert np.allclose(a["value"], b["value"])


def test_row_samples():
    rows = np.arange(100_000)
    share = sampled(rows, 42, 0, 0.3)
    assert abs(share.mean() - 0.3) < 0.01
    assert (share == sampled(rows, 42, 0, 0.3)).all()
    assert abs((share & sampled(rows, 42, 1, 0.3)).mean() - 0.09) < 0.01


def test_best_cuts_of_an_empty_node():
    gain, *_ = best_cuts(np.zeros((3, 1, 2, 4)), 1.0, 0.0, 1.0, 0)
    assert gain[0] == -np.inf


# --- output --------------------------------------------------------------------------------


def test_predict_layout_and_roles(data):
    _, df = data
    model = lr_train(df, "y")
    out = lr_predict(df, model, pred_name="score", save_id=True, save_label=True,
                     col_names=["a", "c"])
    assert out.columns == ["score", "id", "label", "a", "c"]
    assert table_schema(out) == {
        "ids": ["id"],
        "id_types": ["int64"],
        "features": ["a", "c"],
        "feature_types": ["float64", "float64"],
        "labels": ["score", "label"],
        "label_types": ["float64", "int64"],
    }
    assert lr_predict(df, model).columns == ["pred"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_predict_refusals(data):
    _, df = data
    model = lr_train(df, "y")
    with pytest.raises(ValueError, match="unsupported model"):
        predict(df, object())
    with pytest.raises(ValueError, match="no xgb model"):
        xgb_predict(df, model)
    with pytest.raises(ValueError, match="id column"):
        lr_predict(df.select("a", "b", "c"), model, save_id=True)
    with pytest.raises(ValueError, match="not found"):
        lr_predict(df.drop("a"), model)


def test_wide_linear_model_scores_and_counts_missing(spark):
    from featurekit.operators.linear import LinearModel
    from featurekit.operators.project import missing_count

    n = 5000
    wide = spark.range(3).select("id", *[(F.col("id") * (i % 7)).cast("double").alias(f"f{i}") for i in range(n)])
    model = LinearModel(tuple(f"f{i}" for i in range(n)), tuple(0.5 for _ in range(n)), 1.0, False)
    total = sum(i % 7 for i in range(n))
    got = [r["s"] for r in wide.select(model.score(wide).alias("s")).collect()]
    assert got == [1.0, 1.0 + 0.5 * total, 1.0 + total]
    holed = wide.withColumn("f3", F.expr("nullif(f3, 0)"))
    assert holed.agg(missing_count(holed, [f"f{i}" for i in range(n)])).first()[0] == 1


def test_both_linear_solvers_give_one_answer(spark, monkeypatch):
    from featurekit.operators import linear

    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 2))
    y = x @ [1.0, 2.0] + rng.normal(size=12)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    c = x - x.mean(axis=0)
    want = np.linalg.solve(c.T @ c + 5 * np.eye(2), c.T @ (y - y.mean()))
    for limit in (4096, 1):
        monkeypatch.setattr(linear, "NORMAL_FEATURES", limit)
        found = linear.lr_train(df, "y", reg_type="linear", l2_norm=5.0)
        assert np.allclose(found.coefficients, want, atol=1e-6)


@pytest.mark.parametrize("objective", ["reg:squarederror", "binary:logistic"])
def test_exact_trees_against_brute_force(data, objective):
    """Every value of continuous features is a cut, in several ranges and levels."""
    pdf, df = data
    logistic = objective == "binary:logistic"
    label = "y" if logistic else "v"
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf[label].to_numpy().astype(float)
    model = xgb_train(df, label, objective=objective, num_boost_round=2, max_depth=3, tree_method="exact")
    cuts = [np.unique(x[:, f])[:-1] for f in range(3)]
    margin = np.full(len(y), 0.0 if logistic else 0.5)
    for _ in range(2):
        p = 1 / (1 + np.exp(-margin)) if logistic else margin
        h = p * (1 - p) if logistic else np.ones_like(y)
        margin = margin + _tree(x, p - y, h, cuts, 3, 1.0, 0.3)
    want = 1 / (1 + np.exp(-margin)) if logistic else margin
    got = xgb_predict(df, model, save_id=True).toPandas().sort_values("id")["pred"]
    assert np.allclose(got, want, atol=2e-6)


def test_exact_trees_with_a_hot_value_and_missing_ones(spark):
    """A third of the rows share a value, others lack it; the cut is the best of all."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random(9000) < 0.34, 0.25, rng.random(9000))
    x[rng.random(9000) < 0.1] = np.nan
    y = np.where(np.isnan(x), 2.0, (x > 0.7123) * 3.0)
    df = with_roles(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), labels=["y"])
    settings = {"objective": "reg:squarederror", "num_boost_round": 1, "learning_rate": 1.0, "lambda": 0.0}
    model = xgb_train(df, "y", max_depth=2, tree_method="exact", **settings)
    got = xgb_predict(df, model, save_label=True).toPandas()
    assert np.allclose(got["pred"], got["label"], atol=1e-6)
    cut = model.trees[0]["cut"][model.trees[0]["feature"] >= 0]
    assert np.isclose(cut, x[x <= 0.7123].max()).any()
    sampled_model = xgb_train(df, "y", max_depth=2, tree_method="exact", subsample=0.5, colsample_bytree=0.5, **settings)
    assert len(sampled_model.trees[0]["feature"]) >= 3


def _weighted_cuts(x, h, parts):
    value, place = np.unique(x, return_inverse=True)
    upto = np.cumsum(np.bincount(place, h))
    goals = upto[-1] * np.arange(1, parts) / parts
    return [v for v in np.unique(value[np.searchsorted(upto * (1 + 1e-9), goals)]) if v < value[-1]]


def test_approx_proposes_cuts_by_weight(data):
    pdf, df = data
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy().astype(float)
    few = df.withColumns({f: F.round(F.col(f), 1) for f in "ab"})
    x[:, :2] = few.orderBy("id").select("a", "b").toPandas().to_numpy()
    model = xgb_train(few, "y", num_boost_round=4, max_depth=3, tree_method="approx")
    margin = np.zeros(len(y))
    proposed = []
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        h = p * (1 - p)
        cuts = [_weighted_cuts(x[:, f], h, 10) for f in range(3)]
        proposed.append(cuts)
        margin = margin + _tree(x, p - y, h, cuts, 3, 1.0, 0.3)
    got = xgb_predict(few, model, save_id=True).toPandas().sort_values("id")["pred"]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)), atol=2e-6)
    assert proposed[0] != proposed[-1]


def test_weighted_summaries_bound_their_ranks():
    from featurekit.functions.trees import Summaries, merged_summary, pruned_summary, summary_cuts, summary_of

    rng = np.random.default_rng(6)
    x, w = np.round(rng.lognormal(size=60_000), 3), rng.random(60_000)
    x[:20_000] = 1.5  # a third of the rows
    found = Summaries(1, 512)
    for part in np.array_split(np.arange(len(x)), 37):
        found.add(x[part, None], w[part])
    s = found.result(0)
    assert s.shape[1] <= 520
    order = np.argsort(x, kind="stable")
    upto, total = np.cumsum(w[order]), w.sum()
    for value, own, low, high in s.T:
        below = upto[np.searchsorted(x[order], value) - 1] if value > x.min() else 0.0
        assert low - 1e-6 <= below <= high + 1e-6 and high - low <= 0.02 * total
        assert own <= w[x == value].sum() + 1e-6
    goals = np.array(summary_cuts(s, 9))
    shares = [w[x <= g].sum() / total for g in goals]
    assert 1.5 in goals and max(np.diff([0, *shares, 1])) < 0.45
    few = summary_of(np.array([1.0, 2.0, 2.0]), np.array([1.0, 2.0, 3.0]))
    assert merged_summary(few, np.zeros((4, 0))) is few and pruned_summary(few, 9) is few
    assert merged_summary(few, few).tolist() == [[1.0, 2.0], [2.0, 10.0], [0.0, 2.0], [0.0, 2.0]]


def test_sibling_sums_and_stored_nodes_change_nothing(data, monkeypatch):
    pdf, df = data
    settings = {"num_boost_round": 2, "max_depth": 5, "max_bin": 60, "min_child_weight": 3.0}
    want = xgb_train(df, "y", **settings)  # every node is summed
    monkeypatch.setattr(growth, "LEVELS_PER_TABLE", 1)
    monkeypatch.setattr(growth, "KEEP_CELLS", 0)
    monkeypatch.setattr(growth, "BYTES_PER_PARTITION", 1000)
    kept = xgb_train(df, "y", **settings)
    monkeypatch.setattr(growth, "CELLS_PER_JOB", 300)
    narrow = xgb_train(df, "y", **settings)
    for other in (kept, narrow):
        for a, b in zip(want.trees, other.trees, strict=True):
            assert list(a["feature"]) == list(b["feature"]) and list(a["cut"]) == list(b["cut"])
            assert np.allclose(a["value"], b["value"])
    leaves = lgbm_train(df, "v", objective="regression", n_estimators=2, num_leaves=12)
    monkeypatch.setattr(growth, "KEEP_CELLS", 10**9)
    for a, b in zip(leaves.trees, lgbm_train(df, "v", objective="regression", n_estimators=2, num_leaves=12).trees, strict=True):
        assert list(a["cut"]) == list(b["cut"]) and np.allclose(a["value"], b["value"])


@pytest.mark.parametrize("kind", ["gbdt", "dart", "rf", "levels", "sampled"])
@pytest.mark.parametrize("logistic", [False, True])
def test_rows_of_equal_bins_train_as_one(spark, monkeypatch, kind, logistic):
    """A row per combination of bins gives the trees that the rows give, missing cells included."""
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"a": rng.integers(0, 6, n) * 1.0, "b": rng.integers(0, 4, n) * 0.5})
    pdf["v"] = pdf["a"] * pdf["b"] + np.where(pdf["a"] > 2, 1.5, 0) + rng.normal(size=n)
    pdf["y"] = (pdf["v"] > pdf["v"].median()).astype(int)
    pdf.loc[rng.random(n) < 0.1, "a"] = None
    df = with_roles(spark.createDataFrame(pdf.drop(columns="v" if logistic else "y")), labels=["y" if logistic else "v"])
    label = "y" if logistic else "v"
    sizes, rewrite = [], growth.TrainingTable.rewrite

    def counted(self, table):
        rewrite(self, table)
        sizes.append(self.table.count())

    monkeypatch.setattr(growth.TrainingTable, "rewrite", counted)
    monkeypatch.setattr(growth, "SMALL_ROWS", 0)  # rows keep their numbers, so draws are the same

    def train():
        if kind in ("levels", "sampled"):
            objective = "binary:logistic" if logistic else "reg:squarederror"
            share = 0.7 if kind == "sampled" else 1.0
            return xgb_train(df, label, objective=objective, num_boost_round=3, max_depth=3, subsample=share)
        objective = "binary" if logistic else "regression"
        return lgbm_train(df, label, objective=objective, boosting_type=kind, n_estimators=4, num_leaves=8)

    together = train()
    assert sizes and max(sizes) <= 7 * 4
    monkeypatch.setattr(growth, "ROWS_PER_GROUP", 10**9)
    sizes.clear()
    alone = train()
    assert min(sizes) == n
    for a, b in zip(together.trees, alone.trees, strict=True):
        assert list(a["feature"]) == list(b["feature"]) and list(a["cut"]) == list(b["cut"])
        assert list(a["default_left"]) == list(b["default_left"]) and np.allclose(a["value"], b["value"], rtol=1e-9, atol=1e-12)


def test_forest_draws():
    from featurekit.functions.trees import draws

    rows = np.arange(200_000)
    n = draws(rows, 42, 0)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and abs((n == 0).mean() - np.exp(-1)) < 0.01
    assert (n == draws(rows, 42, 0)).all()
    assert abs(np.corrcoef(n, draws(rows, 42, 1))[0, 1]) < 0.01


def test_forest_of_a_determined_label_is_exact_and_repeatable(data):
    pdf, df = data
    fixed = with_roles(df.drop("y").withColumn("v", F.col("c") * 2 + 1), labels=["v"])
    model = lgbm_train(fixed, "v", objective="regression", n_estimators=3, num_leaves=8, boosting_type="rf")
    got = lgbm_predict(fixed, model, save_label=True).toPandas()
    assert np.allclose(got["pred"], got["label"], atol=1e-6)
    again = lgbm_train(fixed, "v", objective="regression", n_estimators=3, num_leaves=8, boosting_type="rf")
    assert [t["value"].tolist() for t in model.trees] == [t["value"].tolist() for t in again.trees]


def test_large_and_small_models_add_in_one_order(spark, monkeypatch):
    """The same bits from both ways to score, whatever the model's size."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.random(500), "y": rng.normal(size=500) * 1e6}))
    model = xgb_train(with_roles(df, labels=["y"]), "y", objective="reg:squarederror", num_boost_round=6, max_depth=3, base_score=0.3)
    small = [r[0] for r in df.select(model.score(df)).collect()]
    monkeypatch.setattr(boosting, "EXPRESSION_NODES", 0)
    assert small == [r[0] for r in df.select(model.score(df)).collect()]


@pytest.mark.parametrize("objective", ["reg:squarederror", "binary:logistic"])
def test_linear_booster_takes_steps(data, monkeypatch, objective):
    """Rounds of coordinate descent by hand; blocks of columns change nothing."""
    from featurekit.operators import linear

    pdf, df = data
    logistic = objective == "binary:logistic"
    label = "y" if logistic else "v"
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf[label].to_numpy().astype(float)
    n, rate, l2, l1 = len(y), 0.4, 0.05 * len(y), 0.02 * len(y)
    b, w, wanted = 0.0 if logistic else 0.5, np.zeros(3), {}
    for rounds in range(1, 6):

        def gradient(z=None):
            margin = b + x @ w
            p = 1 / (1 + np.exp(-margin)) if logistic else margin
            return p - y, p * (1 - p) if logistic else np.ones(n)

        g, h = gradient()
        step = -rate * g.sum() / h.sum()
        b, g = b + step, g + h * step  # within a round, gradients follow the steps
        for j in range(3):
            big_g, big_h = (g * x[:, j]).sum() + l2 * w[j], (h * x[:, j] ** 2).sum() + l2
            sign = 1 if w[j] - big_g / big_h >= 0 else -1
            best = -(big_g + sign * l1) / big_h
            step = rate * (max(best, -w[j]) if sign > 0 else min(best, -w[j]))
            w[j] += step
            g = g + h * x[:, j] * step
        wanted[rounds] = [b, *w]
    settings = {"objective": objective, "booster": "gblinear", "linear_steps": True, "learning_rate": rate, "lambda": 0.05, "alpha": 0.02}
    for rounds in (1, 2, 5):
        model = xgb_train(df, label, num_boost_round=rounds, **settings)
        assert [model.intercept, *model.coefficients] == pytest.approx(wanted[rounds], rel=1e-9, abs=1e-12)
    monkeypatch.setattr(linear, "STEP_COLUMNS", 2)
    model = xgb_train(df, label, num_boost_round=2, **settings)
    # A later block of the logistic loss sees gradients made anew, so only squares agree exactly.
    assert [model.intercept, *model.coefficients] == pytest.approx(wanted[2], rel=1e-9, abs=0.01 if logistic else 1e-12)


@pytest.mark.parametrize("trees,leaves", [(1, 32), (4, 8), (3, 50)])
def test_scoring_code_fits_the_jit(spark, monkeypatch, trees, leaves):
    """Methods of more than 8000 bytes are interpreted, so every row would be scored slowly."""
    pdf = pd.DataFrame({"x": np.repeat(np.arange(50.0), 25)})
    pdf["y"] = np.random.default_rng(3).random(50)[pdf["x"].astype(int)]
    df = spark.createDataFrame(pdf).coalesce(1)
    model = lgbm_train(with_roles(df, labels=["y"]), "y", objective="regression", n_estimators=trees, num_leaves=leaves)
    seen = df.select(model.score(df).alias("pred"))._jdf.queryExecution().debug().codegenToSeq()
    assert max(seen.apply(i)._3().maxMethodCodeSize() for i in range(seen.size())) <= 8000
    found = []
    for limit in (10_000, 0):
        monkeypatch.setattr(boosting, "EXPRESSION_NODES", limit)
        found.append([r[0] for r in df.select(model.score(df)).collect()])
    assert found[0] == found[1]


@pytest.mark.parametrize("forest", [True, False])
def test_trees_share_the_scan_of_drawn_rows(spark, monkeypatch, forest):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 8, 600) * 1.0})
    pdf["v"] = pdf["a"] ** 2 + rng.normal(size=600)
    df = with_roles(spark.createDataFrame(pdf), labels=["v"])
    scans, draw = [], growth.BinnedTable.draw
    monkeypatch.setattr(growth.BinnedTable, "draw", lambda self, trees: (scans.append(len(trees)), draw(self, trees)))

    def train():
        if forest:
            return lgbm_train(df, "v", objective="regression", boosting_type="rf", n_estimators=5, num_leaves=3)
        return xgb_train(df, "v", objective="reg:squarederror", num_boost_round=5, max_depth=1, subsample=0.6)

    together = train()
    assert scans == [4, 1]
    monkeypatch.setattr(growth, "TREES_PER_DRAW", 1)
    for a, b in zip(together.trees, train().trees, strict=True):
        assert list(a["feature"]) == list(b["feature"]) and list(a["cut"]) == list(b["cut"])
        assert np.allclose(a["value"], b["value"], rtol=1e-9)
    assert scans == [4, 1, 1, 1, 1, 1, 1]
