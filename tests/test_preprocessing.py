import numpy as np
import pandas as pd
import pytest

from featurekit import feature_filter, psi, table_schema, train_test_split, with_roles
from featurekit.functions import ordered
from featurekit.operators import join


def test_join_two_halves(spark):
    left = with_roles(
        spark.createDataFrame([(i, i * 0.5) for i in range(50)], "id long, radius double"), ids=["id"]
    )
    right = with_roles(
        spark.createDataFrame([(i, i % 2 == 0) for i in range(20, 90)], "id long, target boolean"),
        ids=["id"],
        labels=["target"],
    )
    out = psi(left, right, keys=["id"])
    assert out.columns == ["id", "radius", "target"]
    assert out.count() == 30
    assert table_schema(out) == {
        "ids": ["id"],
        "id_types": ["int64"],
        "features": ["radius"],
        "feature_types": ["float64"],
        "labels": ["target"],
        "label_types": ["bool"],
    }


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(0)
    left = pd.DataFrame(
        {"k": rng.choice([1.0, 2.0, 3.0, np.nan], 3000, p=[0.35, 0.3, 0.3, 0.05]), "x": range(3000)}
    )
    right = pd.DataFrame({"kk": [1.0, 2.0, 3.0, 3.0, np.nan, 9.0] * 3, "y": range(18)})
    third = pd.DataFrame({"k": [1.0, 2.0, np.nan] * 20, "z": range(60)})

    def load(pdf, schema):
        rows = [tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)]
        return spark.createDataFrame(rows, schema)

    frames = (
        load(left, "k double, x long"),
        load(right, "kk double, y long"),
        load(third, "k double, z long"),
    )
    return (left, right, third), frames


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_join_duplicates_nulls_and_hot_keys(spark, skewed, threshold):
    (left, right, third), frames = skewed
    want = left.merge(right, left_on="k", right_on="kk").merge(third, on="k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = psi(*frames, keys=[["k"], ["kk"], ["k"]])
        assert out.columns == ["k", "x", "kk", "y", "z"]
        got = out.toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    order = ["x", "y", "z"]
    got, want = (d.sort_values(order)[order].to_numpy() for d in (got, want))
    assert np.array_equal(got, want)
    dropped = psi(*frames[:2], keys=[["k"], ["kk"]], null_keys="drop")
    assert dropped.count() == len(left.dropna().merge(right.dropna(), left_on="k", right_on="kk"))


def test_join_of_maps_and_equal_rows_runs_nothing_when_called(spark):
    hot = spark.range(3000).selectExpr("1L AS k", "map('a', 1) AS m").repartition(6)
    other = spark.createDataFrame([(1, 2), (2, 3)], "k long, v long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy join", "")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = psi(hot, other, keys=["k"])
        assert not tracker.getJobIdsForGroup("lazy join")
        assert out.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_join_refusals(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([("1", 2)], "id string, v long")
    with pytest.raises(ValueError, match="different types"):
        psi(a, b, keys=["id"])
    with pytest.raises(ValueError, match="two inputs"):
        psi(a, a, keys=["id"])
    with pytest.raises(ValueError, match="same number"):
        psi(a, b, keys=[["id", "name"], ["id"]])
    with pytest.raises(ValueError, match="case"):
        psi(a, a.withColumnsRenamed({"id": "ID", "name": "n2"}), keys=[["id"], ["ID"]])
    with pytest.raises(ValueError, match="inputs"):
        psi(a, keys=["id"])


def test_feature_filter(people):
    out = feature_filter(people, ["AGE", "NAME", "missing"])
    assert out.columns == ["ID", "ADDRESS", "SALARY"]
    assert table_schema(out)["ids"] == ["ID"]
    with pytest.raises(ValueError):
        feature_filter(people, [])


@pytest.mark.parametrize("limit", [100_000, 25])
@pytest.mark.parametrize(
    "how",
    [{}, {"key": "k"}, {"shuffle": False, "order_by": ["k"]}, {"shuffle": False, "order_by": ["k", "x"]}],
)
def test_split_is_exact_with_copies_and_hot_keys(spark, skewed, monkeypatch, limit, how):
    base = skewed[1][0]
    copies = spark.range(900).selectExpr("cast(1 as double) k", "cast(5 as long) x")
    df = base.unionAll(base.filter("x < 10")).unionAll(copies)
    monkeypatch.setattr(ordered, "COLLECT_LIMIT", limit)
    n = df.count()
    train, test = (d.toPandas() for d in train_test_split(df, train_size=0.3, **how))
    assert len(train) == int(n * 0.3)
    both = pd.concat([train, test]).sort_values(["k", "x"]).reset_index(drop=True)
    want = df.toPandas().sort_values(["k", "x"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(both, want)
    if "order_by" in how:
        first, second = (d[how["order_by"]].fillna(-1).apply(tuple, axis=1) for d in (train, test))
        assert first.max() <= second.min()


def test_split_counts_and_seed(spark):
    df = spark.range(569)

    def ids(**kwargs):
        return {r[0] for r in train_test_split(df, train_size=0.8, **kwargs)[0].collect()}

    assert len(ids()) == 455
    assert ids() == ids(random_state=1024) != ids(random_state=7)
    assert ids(random_state=None) != ids(random_state=None)
    assert ids(fix_random=False) != ids()
    repartitioned = {r[0] for r in train_test_split(df.repartition(3), train_size=0.8)[0].collect()}
    assert repartitioned == ids()
    train, test = train_test_split(df, train_size=0.8, exact=False)
    assert train.count() + test.count() == 569
    with pytest.raises(ValueError):
        train_test_split(spark.range(1), train_size=0.5)


def test_unshuffled_split_in_file_order(spark, tmp_path):
    """First rows by file and place: several files, rows in no order of their values."""
    path = str(tmp_path / "t")
    rows = [(i, (i * 7919) % 1000, "x") for i in range(1000)]
    spark.createDataFrame(rows, "n long, v long, __place0 string").repartition(6).write.parquet(path)
    df = spark.read.parquet(path)
    files = [pd.read_parquet(f) for f in sorted((tmp_path / "t").glob("*.parquet"))]
    want = [tuple(r) for f in files for r in f.itertuples(index=False)]
    train, test = train_test_split(df, shuffle=False, train_size=0.37)
    assert train.columns == test.columns == df.columns
    assert sorted(map(tuple, train.collect())) == sorted(want[:370])
    assert sorted(map(tuple, test.collect())) == sorted(want[370:])
    some = df.where("v % 3 = 0")
    kept = [r for r in want if r[1] % 3 == 0]
    assert sorted(map(tuple, train_test_split(some, shuffle=False, train_size=0.5)[0].collect())) == sorted(kept[: len(kept) // 2])
    with pytest.raises(ValueError, match="order_by"):
        train_test_split(spark.createDataFrame(rows, "n long, v long, s string"), shuffle=False)
