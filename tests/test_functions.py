import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurekit.functions import bins, ordered, quantiles
from featurekit.functions.linear_algebra import inflation_factors


@pytest.fixture(scope="module")
def mixed(spark):
    """A third of one column is a single value; one column spans 80 orders of magnitude."""
    rng = np.random.default_rng(0)
    n = 6000
    pdf = pd.DataFrame(
        {
            "a b": rng.normal(size=n),
            "hot": np.where(rng.random(n) < 0.34, 7.0, rng.exponential(size=n)),
            "few": rng.integers(0, 11, n).astype(float),
            "one": np.full(n, 3.0),
            "wide": np.exp(rng.normal(size=n) * 50),
        }
    )
    pdf.loc[::7, "hot"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("limit", [1_000_000, 40])
@pytest.mark.parametrize("count", [4, 150])
def test_quantiles_equal_pandas_bit_for_bit(mixed, monkeypatch, limit, count):
    pdf, df = mixed
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", limit)
    probs = bins.equal_frequency_probs(count)
    found = quantiles.exact_quantiles(df, list(pdf.columns), probs)
    for c in pdf:
        assert found[c] == list(pdf[c].quantile(probs)), c


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]) == {"x": None}
    assert quantiles.exact_quantiles(spark.range(1), ["id"], [0.25, 1.0]) == {"id": [0.0, 0.0]}


def test_only_values_that_were_read_are_sketched(spark):
    """Rows between the brackets are counted by hash, whatever the number of groups."""
    rows = [(0, 2 * i, None) for i in range(300) for _ in range(3)] + [(1, 7, float(i)) for i in range(50)]
    coded = spark.createDataFrame(rows, "c int, code int, v double")
    found = quantiles._sketched(coded)
    got = {(r["c"], r["code"]): (r["n"], r["low"], r["high"]) for r in found.collect()}
    assert got == {**{(0, 2 * i): (3, None, None) for i in range(300)}, (1, 7): (50, 0.0, 49.0)}
    assert [r["grid"] and len(r["grid"]) for r in found.where("c = 1 OR code = 0").orderBy("c").collect()] == [None, 201]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sketched = plan[plan.index("percentile_approx") :]
    assert "Filter isnotnull(v" in sketched[: sketched.index("Aggregate [", 1)]


@pytest.mark.parametrize("right_closed", [True, False])
@pytest.mark.parametrize("count", [1, 5, 300])
def test_bin_numbers(spark, right_closed, count):
    edges = [float(e) for e in np.linspace(-3, 3, count)]
    values = [*edges, -0.0, 0.0, -9.0, 9.0, 0.1234, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["b"] for r in bins.with_bin_number(df, "b", "x", edges, right_closed).collect()]
    side = "left" if right_closed else "right"
    assert got == [None if v is None else int(np.searchsorted(edges, v, side)) for v in values]


@pytest.mark.parametrize("count", [3, 120])
def test_bin_numbers_with_repeated_edges(spark, count):
    edges = sorted([*map(float, range(count)), 1.0, 1.0])
    values = [-1.0, 0.0, 0.5, 1.0, 1.5, float(count), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["b"] for r in bins.with_bin_number(df, "b", "x", edges).collect()]
    assert got == [None if v is None else int(np.searchsorted(edges, v)) for v in values]


def test_labels_of_known_edges():
    assert bins.rounded_edges([14.22333, 22.1166, 29.74], lower_first=False) == [14.223, 22.117, 29.74]
    assert bins.rounded_edges([0.000256789, 0.5], lower_first=False) == [0.000257, 0.5]
    assert bins.rounded_edges([1.00013, 1.00014, 2.0], lower_first=False) == [1.00013, 1.00014, 2.0]
    assert bins.rounded_edges([0.0, 1.0]) == [-0.001, 1.0]
    assert bins.rounded_edges([]) == []


def test_edges_and_labels_equal_pandas():
    rng = np.random.default_rng(1)
    for scale in (1e-4, 1.0, 37.5, 1e6):
        x = rng.normal(size=500) * scale
        cats, edges = pd.cut(x, 7, retbins=True)
        assert bins.equal_width_edges(x.min(), x.max(), 7) == list(edges)
        cats, edges = pd.qcut(x, 7, retbins=True)
        labels = [c.right for c in cats.categories]
        assert bins.rounded_edges(list(edges))[1:] == labels
        assert bins.rounded_edges(list(edges))[0] == cats.categories[0].left
    for c in (0.0, 5.0, -2.0):
        edges = pd.cut(np.full(3, c), 4, retbins=True)[1]
        assert bins.equal_width_edges(c, c, 4) == list(edges)


def test_running_totals(spark):
    rng = np.random.default_rng(2)
    keys = np.where(rng.random(4000) < 0.34, 0.5, rng.random(4000).round(3))
    pdf = pd.DataFrame({"k": keys, "v": rng.integers(0, 5, 4000)})
    rows = spark.createDataFrame(pdf).repartition(6)
    groups = rows.groupBy("k").agg(F.sum("v").alias("v"))
    sketch = rows.agg(F.percentile_approx("k", [i / 20 for i in range(1, 20)], 1000)).first()[0]
    bounds = ordered.range_bounds(sketch, float(keys.max()))
    out = ordered.running_totals(rows, groups, "k", ("v",), bounds)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = out.toPandas().sort_values("k", ascending=False)
    want = pdf.groupby("k")["v"].sum().sort_index(ascending=False)
    assert list(got["cum_v"]) == list(want.cumsum())
    assert list(got["next_v"])[:-1] == list(want)[1:]
    assert np.isnan(list(got["next_v"])[-1])


def test_inflation_factors():
    r = np.array([[1.0, 0.5, 0.5], [0.5, 1.0, 0.25], [0.5, 0.25, 1.0]])
    assert np.allclose(inflation_factors(r), np.diag(np.linalg.inv(r)))
    # c = a: both infinite, b untouched.
    r = np.array([[1.0, 0.3, 1.0], [0.3, 1.0, 0.3], [1.0, 0.3, 1.0]])
    found = inflation_factors(r)
    assert found[0] == found[2] == np.inf
    assert np.isclose(found[1], 1 / (1 - 0.09))
    assert inflation_factors(np.array([[1.0]])) == [1.0]
    assert inflation_factors(np.zeros((0, 0))) == []
    x = np.random.default_rng(0).normal(size=(2000, 300))
    x[:, 7] = x[:, 3] - 2 * x[:, 5]
    r = np.corrcoef(x.T)
    found = np.array(inflation_factors(r))
    assert set(np.flatnonzero(np.isinf(found))) == {3, 5, 7}
    others = [i for i in range(300) if i not in (3, 5, 7)]
    rest = [i for i in range(300) if i != 7]
    want = np.diag(np.linalg.inv(r[np.ix_(rest, rest)]))
    assert np.allclose(found[others], [want[rest.index(i)] for i in others])
