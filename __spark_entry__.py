"""Queries over the test tables, one per operator, with their SQL equivalents.

``entry`` runs the flagship query, ``queries`` maps names to functions of (session, table
folder), ``oracle_sql`` maps the same names to SQL over the same tables. Floating-point
results are rounded on both sides, as sums depend on the order of the rows. Before that
they are raised by a thousandth of the last digit: averages of decimal data often lie
exactly half-way between two rounded values, where the last bit would decide.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import featurekit as fk  # noqa: E402
from featurekit.operators.stats import COUNTS, STATISTICS  # noqa: E402
from featurekit.session import shared_folder  # noqa: E402
from featurekit.sources.tables import read_csv, read_parquet, write_csv, write_parquet  # noqa: E402

# The training-data operators and their pipeline are an optional part.
try:
    import corpus_pipeline
    from featurekit.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name != "corpus_pipeline" and not missing.name.startswith("featurekit.llm"):
        raise
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(x: Column | str) -> Column:
    """Eight significant digits."""
    x = F.col(x) if isinstance(x, str) else x
    x = x * F.lit(1 + 1e-10) + F.lit(0.0)
    return F.when(x.isNotNull(), F.format_string("%.7e", x).cast("double"))


def _digits_sql(x: str) -> str:
    return f"CAST(printf('%.7e', CAST({x} AS DOUBLE) * (1 + 1e-10) + 0.0) AS DOUBLE)"


def _round(x: Column | str, digits: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: _round(c, digits) for c in columns})


# --- joins, selections, splits ------------------------------------------------------------


def _join_inner_multiway(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    left = orders.select("o_orderkey", "o_totalprice")
    right = orders.select(F.col("o_orderkey").alias("order_ref"), "o_orderpriority")
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return fk.psi(left, right, items, keys=[["o_orderkey"], ["order_ref"], ["l_orderkey"]])


def _join_null_keys(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("nullif(c_nationkey, 3)").alias("nation"), "c_mktsegment"
    )
    nation = _table(spark, sf_dir, "nation").select(
        F.expr("nullif(n_nationkey, 3)").alias("nation"), "n_name"
    )
    return fk.psi(customer, nation, keys=["nation"])


def _join_two_keys(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    left = items.select("l_orderkey", "l_linenumber", "l_quantity")
    right = items.select("l_orderkey", F.col("l_linenumber").alias("line"), "l_tax")
    return fk.psi(left, right, keys=[["l_orderkey", "l_linenumber"], ["l_orderkey", "line"]])


def _join_hot_key(spark, sf_dir):
    """A key with three values, each of which holds a third of the rows."""
    items = _table(spark, sf_dir, "lineitem")
    totals = items.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("flag_rows"))
    left = items.select("l_orderkey", "l_linenumber", "l_returnflag")
    return fk.psi(left, totals, keys=[["l_returnflag"], ["flag"]])


def _feature_filter(spark, sf_dir):
    return fk.feature_filter(_table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"])


def _split(spark, sf_dir, part, **kwargs):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return fk.train_test_split(orders, **kwargs)[part]


def _split_file_order(spark, sf_dir):
    """The first rows of several files, without a column to order by."""
    path = shared_folder(spark)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    write_parquet(orders.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    return fk.train_test_split(read_parquet(spark, path), shuffle=False, train_size=0.55)[0]


# --- statistics ---------------------------------------------------------------------------


def _statistics(df: DataFrame) -> DataFrame:
    found = fk.table_statistics(df)
    return found.select("feature", "datatype", *COUNTS, *[_digits(F.col(f"`{c}`")).alias(c) for c in STATISTICS])


def _table_statistics(spark, sf_dir):
    return _statistics(
        _table(spark, sf_dir, "lineitem").select(
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
        )
    )


def _table_statistics_nulls(spark, sf_dir):
    return _statistics(
        _table(spark, sf_dir, "lineitem").select(
            F.expr("nullif(l_quantity, 50)").alias("l_quantity"),
            F.expr("nullif(l_returnflag, 'A')").alias("l_returnflag"),
        )
    )


_CORRELATED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _pearsonr(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(*_CORRELATED, "l_returnflag")
    return _rounded(fk.pearsonr(items), 6, "r")


def _pearsonr_constant(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_tax", F.lit(7.0).alias("constant")
    )
    return _rounded(fk.pearsonr(items), 6, "r")


def _priced(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(
        "l_extendedprice",
        "l_discount",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )


def _vif(spark, sf_dir):
    return fk.vif(_priced(spark, sf_dir)).withColumn("vif", _digits("vif"))


# --- bins and weight of evidence ----------------------------------------------------------


def _edges(spark, df, features, method, bins):
    found = fk.bin_edges(df, features, method, bins)
    rows = [(f, i, e) for f, edges in found.items() for i, e in enumerate(edges)]
    return _rounded(spark.createDataFrame(rows, "feature string, i int, edge double"), 6, "edge")


def _bin_edges_quantile(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    return _edges(spark, items, ["l_quantity", "l_extendedprice", "l_discount"], "quantile", 10)


def _bin_edges_width(spark, sf_dir):
    return _edges(spark, _table(spark, sf_dir, "events"), ["value"], "bucket", 8)


def _labelled(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        F.expr("nullif(l_quantity, 50)").alias("quantity_known"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        (F.col("l_extendedprice") / 105000).alias("score"),
    )


def _rules(found: fk.WoeBinning) -> DataFrame:
    rows = found.rules.select("feature", F.posexplode("bins").alias("bin", "b"), "else_woe")
    return rows.select(
        "feature",
        "bin",
        _round("b.right", 3).alias("right_edge"),
        _round("b.woe", 6).alias("woe"),
        _round("else_woe", 6).alias("else_woe"),
    )


def _woe_labels(spark, sf_dir):
    """Rule edges exactly as labels show them, of a feature below 1 and one above."""
    df = _table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") / 1000000).alias("small"),
        (F.col("l_extendedprice") / 7).alias("large"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
    )
    found = fk.woe_binning(df, ["small", "large"], "returned", binning_method="quantile", bin_num=6)
    rows = found.rules.select("feature", F.posexplode("bins").alias("bin", "b"))
    return rows.select("feature", "bin", F.col("b.right").alias("right_edge"))


def _woe(method):
    def run(spark, sf_dir):
        df = _labelled(spark, sf_dir)
        features = ["l_quantity", "l_extendedprice"]
        return _rules(
            fk.woe_binning(df, features, "returned", binning_method=method, bin_num=5)
        )

    return run


def _woe_else_bin(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return _rules(fk.woe_binning(df, ["quantity_known"], "returned", bin_num=5))


def _woe_report(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    report = fk.woe_binning(df, ["quantity_known"], "returned", bin_num=5).report
    return report.select(
        "feature",
        "bin_count",
        _round("feature_iv", 8).alias("feature_iv"),
        (F.col("label") == "else").alias("is_else"),
        _round("woe", 6).alias("woe"),
        _round("iv", 8).alias("iv"),
        "total",
        "pos_count",
    )


_FIXED_RULES = [
    {
        "feature": "quantity_known",
        "bins": [
            {"right": 10.0, "woe": -0.5},
            {"right": 25.5, "woe": 0.125},
            {"right": 40.0, "woe": 0.75},
        ],
        "else_woe": -9.0,
    },
    {"feature": "l_extendedprice", "bins": [{"right": 50000.0, "woe": 1.5}, {"right": 9e4, "woe": 2.5}]},
]


def _woe_substitution(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.expr("nullif(l_quantity, 50)").alias("quantity_known"),
    )
    return fk.woe_substitution(items, _FIXED_RULES)


# --- models -------------------------------------------------------------------------------


def _lr_linear_1f(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = fk.lr_train(items, "l_extendedprice", reg_type="linear", l2_norm=1000.0)
    row = [(model.features[0], model.coefficients[0], model.intercept)]
    found = spark.createDataFrame(row, "feature string, coefficient double, intercept double")
    return found.withColumns({c: _digits(c) for c in ("coefficient", "intercept")})


def _gblinear_1f(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = fk.xgb_train(
        items, "l_extendedprice", booster="gblinear", objective="reg:squarederror", **{"lambda": 0.5, "alpha": 0.0}
    )
    row = [(model.features[0], model.coefficients[0], model.intercept)]
    found = spark.createDataFrame(row, "feature string, coefficient double, intercept double")
    return found.withColumns({c: _digits(c) for c in ("coefficient", "intercept")})


def _gblinear_steps(spark, sf_dir):
    """Weights after one, two and seven rounds."""
    items = _table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    rows = []
    for rounds in (1, 2, 7):
        model = fk.xgb_train(
            items, "price", booster="gblinear", objective="reg:squarederror", linear_steps=True,
            num_boost_round=rounds, **{"lambda": 0.5, "alpha": 2.0},
        )
        rows.append((rounds, model.coefficients[0], model.intercept))
    found = spark.createDataFrame(rows, "rounds int, coefficient double, intercept double")
    return found.withColumns({c: _digits(c) for c in ("coefficient", "intercept")})


def _lr_linear_predict(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    train = items.select("l_quantity", "l_extendedprice")
    model = fk.lr_train(train, "l_extendedprice", reg_type="linear", l2_norm=1.0)
    scored = fk.lr_predict(
        items, model, ids="l_orderkey", label="l_extendedprice", save_id=True, id_name="order",
        save_label=True, label_name="price", col_names=["l_linenumber"],
    )
    return _rounded(scored, 3, "pred")


def _training(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    return fk.with_roles(
        items.select(
            "l_orderkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 40000).cast("int").alias("big"),
        ),
        ids=["l_orderkey"],
        labels=["big"],
    )


def _scaled(df: DataFrame) -> DataFrame:
    return df.withColumn("l_extendedprice", F.col("l_extendedprice") / 100000)


def _predicted(predict, train, prepare=lambda df: df, **attributes):
    def run(spark, sf_dir):
        df = prepare(_training(spark, sf_dir))
        model = train(df, "big", **attributes)
        return predict(df, model, save_id=True, save_label=True)

    return run


def _gbdt_stump(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(
        "l_extendedprice",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100000).alias("net"),
    )
    model = fk.xgb_train(
        items, "net", objective="reg:squarederror", num_boost_round=1, max_depth=1
    )
    tree = model.trees[0]
    row = [(float(tree["cut"][0]), float(tree["value"][1]), float(tree["value"][2]))]
    found = spark.createDataFrame(row, "threshold double, left_value double, right_value double")
    return _rounded(found, 6, "threshold", "left_value", "right_value")


def _stumps(model, digits: int = 6) -> DataFrame:
    """A row per tree: its one split and the values of both sides."""
    spark = SparkSession.getActiveSession()
    rows = [
        (i, model.features[t["feature"][0]], float(t["cut"][0]), float(t["value"][1]), float(t["value"][2]))
        for i, t in enumerate(model.trees)
    ]
    found = spark.createDataFrame(
        rows, "tree int, feature string, threshold double, left_value double, right_value double"
    )
    return _rounded(found, digits, "threshold", "left_value", "right_value")


def _gbdt_exact(spark, sf_dir):
    """Every distinct price is a cut."""
    items = _table(spark, sf_dir, "lineitem").select(
        "l_extendedprice",
        "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100000).alias("net"),
    )
    return _stumps(
        fk.xgb_train(
            items, "net", objective="reg:squarederror", num_boost_round=1, max_depth=1, tree_method="exact"
        )
    )


def _gbdt_approx(spark, sf_dir):
    """The first tree gives rows unequal weights, which move the quantiles of the second one."""
    items = _table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", (F.col("l_extendedprice") > 40000).cast("int").alias("big")
    )
    return _stumps(fk.xgb_train(items, "big", num_boost_round=2, max_depth=1, tree_method="approx"))


def _gbdt_two_rounds(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", (F.col("l_extendedprice") > 40000).cast("int").alias("big")
    )
    return _stumps(fk.xgb_train(items, "big", num_boost_round=2, max_depth=1))


def _rf_determined(spark, sf_dir):
    """The label follows from the feature: trees on any draw of the rows agree."""
    items = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") * F.col("l_quantity") + 3).alias("square")
    )
    df = fk.with_roles(items, ids=["l_orderkey", "l_linenumber"], labels=["square"])
    model = fk.lgbm_train(
        df, "square", objective="regression", boosting_type="rf", n_estimators=3, num_leaves=60
    )
    return _rounded(fk.lgbm_predict(df, model, save_id=True, col_names=["l_linenumber", "l_quantity"]), 3, "pred")


def _quantity_prices(spark, sf_dir):
    return fk.with_roles(
        _table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
        ),
        ids=["l_orderkey", "l_linenumber"],
        labels=["l_extendedprice"],
    )


def _group_means(train, predict, **attributes):
    """A tree deep enough to part all values of its one feature predicts their means."""

    def run(spark, sf_dir):
        df = _quantity_prices(spark, sf_dir)
        model = train(df, "l_extendedprice", **attributes)
        scored = predict(df, model, save_id=True, col_names=["l_linenumber", "l_quantity"])
        return _rounded(scored, 3, "pred")

    return run


def _lr_logistic_groups(spark, sf_dir):
    """Without a penalty, one yes/no feature gives each group its share of positives."""
    df = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        (F.col("l_quantity") > 20).cast("int").alias("many"),
    )
    df = fk.with_roles(df, ids=["l_orderkey", "l_linenumber"], labels=["many"])
    model = fk.lr_train(df, "many", l2_norm=0.0, max_iter=100, tol=1e-12)
    scored = fk.lr_predict(df, model, save_label=True, label_name="many", col_names=["returned"])
    return _rounded(scored, 5, "pred")


# --- evaluation ---------------------------------------------------------------------------


def _roc_curve(spark, sf_dir):
    found = fk.roc_curve(_labelled(spark, sf_dir), "returned", "score")
    return _rounded(found, 9, "threshold", "fpr", "tpr")


def _report(part, digits=9, **attributes):
    def run(spark, sf_dir):
        report = fk.biclassification_eval(
            _labelled(spark, sf_dir), "returned", "score", **attributes
        )
        df = getattr(report, part)
        doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
        return _rounded(df, digits, *doubles)

    return run


def _bias(method):
    def run(spark, sf_dir):
        found = fk.prediction_bias_eval(
            _labelled(spark, sf_dir), "returned", "score", bucket_num=8, bucket_method=method
        ).drop("interval")
        return _rounded(
            found, 8, "left_endpoint", "right_endpoint", "avg_prediction", "avg_label", "bias"
        )

    return run


# --- files and chains ---------------------------------------------------------------------


def _csv_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    write_csv(_table(spark, sf_dir, "customer"), path)
    schema = {
        "ids": ["c_custkey"],
        "id_types": ["int64"],
        "features": ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        "feature_types": ["str", "int", "float", "str"],
    }
    return read_csv(spark, path, schema)


def _csv_roundtrip_text(spark, sf_dir):
    """Whole documents, with quotes, commas and line breaks in their cells."""
    path = shared_folder(spark)
    write_csv(_table(spark, sf_dir, "documents"), path)
    schema = {
        "ids": ["doc_id"],
        "id_types": ["int64"],
        "features": ["text", "lang", "source", "n_chars"],
        "feature_types": ["str", "str", "str", "int64"],
    }
    return read_csv(spark, path, schema)


def _profile_joined(spark, sf_dir):
    """Two parties' tables joined on the customer, then every feature profiled."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    joined = fk.psi(
        fk.with_roles(orders, ids=["o_custkey"]),
        fk.with_roles(customer, ids=["c_custkey"]),
        keys=[["o_custkey"], ["c_custkey"]],
    )
    return _statistics(joined)


def _chain_join_to_report(spark, sf_dir):
    """Join, split, train, score the held-out part, evaluate: tasks chained by tables in the
    shared folder, so that each step reads its input once written."""
    folder = shared_folder(spark)
    items = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") / 100000).alias("price"),
        "l_discount",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) > 40000).cast("int").alias("big"),
    )
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000000).alias("order_total")
    )
    joined = fk.psi(
        fk.with_roles(items, ids=["l_orderkey", "l_linenumber"], labels=["big"]),
        fk.with_roles(orders, ids=["o_orderkey"]),
        keys=[["l_orderkey"], ["o_orderkey"]],
    )
    write_parquet(joined, f"{folder}/joined")

    def parquet(name):
        return {"data_path": f"{folder}/{name}", "format": "parquet"}

    fk.run_task(
        spark,
        {
            "component_name": "train_test_split",
            "train_size": 0.8,
            "key": ["l_orderkey", "l_linenumber"],
            "inputs": [parquet("joined")],
            "outputs": [parquet("train"), parquet("test")],
        },
    )
    fk.run_task(
        spark,
        {
            "component_name": "lr_train",
            "max_iter": 20,
            "inputs": [{**parquet("train"), "label": ["big"]}],
            "outputs": [{"data_path": f"{folder}/model"}],
        },
    )
    fk.run_task(
        spark,
        {
            "component_name": "lr_predict",
            "save_label": True,
            "inputs": [parquet("test"), {"data_path": f"{folder}/model"}],
            "outputs": [parquet("scored")],
        },
    )
    scored = read_parquet(spark, f"{folder}/scored")
    return fk.biclassification_eval(scored, "label", "pred").summary


# --- SQL equivalents ----------------------------------------------------------------------

_SPLIT_SQL = """
    SELECT o_orderkey, o_custkey, o_totalprice FROM (
        SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM orders
    ) WHERE rn {side} floor(n * {share})
"""


def _statistics_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """``columns``: name and kind (float64, int64 or str)."""
    parts = []
    for name, kind in columns:
        if kind == "str":
            numeric = ", ".join(f'CAST(NULL AS DOUBLE) AS "{c}"' for c in STATISTICS[1:])
            body = f"SELECT count(*) AS n_all, count({name}) AS n, {numeric} FROM src"
        else:
            x = f"CAST({name} AS DOUBLE)"
            body = f"""SELECT count(*) AS n_all, count({name}) AS n,
                min({x}) AS "min", max({x}) AS "max", avg({x}) AS "mean",
                var_samp({x}) AS "var(variance)", stddev_samp({x}) AS "std(standard deviation)",
                stddev_samp({x}) / sqrt(count({name})) AS "sem(standard error)",
                skewness({x}) AS "skew", kurtosis({x}) AS "kurtosis",
                quantile_cont({x}, 0.25) AS "q1(first quartile)",
                quantile_cont({x}, 0.5) AS "q2(second quartile, median)",
                quantile_cont({x}, 0.75) AS "q3(third quartile)",
                avg({x}**2) AS moment_2, avg({x}**3) AS moment_3, avg({x}**4) AS moment_4,
                avg(({x} - mu)**2) AS central_moment_2, avg(({x} - mu)**3) AS central_moment_3,
                avg(({x} - mu)**4) AS central_moment_4,
                sum({x}) AS "sum", sum({x}**2) AS sum_2, sum({x}**3) AS sum_3, sum({x}**4) AS sum_4
                FROM src, (SELECT avg(CAST({name} AS DOUBLE)) AS mu FROM src)"""
        shown = ", ".join(f'{_digits_sql(chr(34) + c + chr(34))} AS "{c}"' for c in STATISTICS[1:])
        ratio = _digits_sql("(n_all - n) / n_all")
        parts.append(
            f"""SELECT '{name}' AS feature, '{kind}' AS datatype, n_all AS total_count,
            n AS "count(non-NA count)", n_all - n AS "count_na(NA count)",
            {ratio} AS na_ratio, {shown} FROM ({body})"""
        )
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


def _pearsonr_sql(columns: tuple[str, ...], source: str, constant: str = "") -> str:
    parts = []
    for a in columns:
        for b in columns:
            if constant in (a, b):
                r = "999.0"
            else:
                r = "1.0" if a == b else f"round(corr({a}, {b}) + 1e-9, 6)"
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r} AS r FROM src")
    # One row per pair even where no aggregate is involved.
    parts = [p if "corr(" in p else p.replace(" FROM src", "") for p in parts]
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


_LABELLED_SQL = """src AS (
    SELECT l_quantity, l_extendedprice, nullif(l_quantity, 50) AS quantity_known,
        CAST(l_returnflag = 'R' AS INT) AS returned, l_extendedprice / 105000 AS score
    FROM lineitem)"""


def _quantile_edges(x: str, bins: int, source: str = "src") -> str:
    probs = ", ".join(str(i / bins) for i in range(bins + 1))
    return (
        f"SELECT list_sort(list_distinct(quantile_cont({x}, [{probs}]))) AS e FROM {source}"
    )


def _width_edges(x: str, bins: int, source: str = "src") -> str:
    return f"""SELECT list_transform(range({bins + 1}), lambda i:
        CASE WHEN i = 0 THEN lo - 0.001 * (hi - lo) ELSE lo + i * (hi - lo) / {bins} END) AS e
        FROM (SELECT min({x}) AS lo, max({x}) AS hi FROM {source})"""


def _woe_sql(features: list[str], edges: Callable[[str, int], str], report: bool = False) -> str:
    parts = []
    for f in features:
        parts.append(
            f"""SELECT '{f}' AS feature, b AS bin, e[b + 2] AS right_edge, total, pos,
                len(e) - 1 AS bin_count,
                CASE WHEN pos < 1 THEN 0.5 ELSE pos END AS p,
                CASE WHEN total - pos < 1 THEN 0.5 ELSE total - pos END AS n
            FROM (
                SELECT CASE WHEN {f} IS NULL THEN -1 ELSE
                    len(list_filter(e[2:len(e) - 1], lambda t: t < {f})) END AS b,
                    count(*) AS total, sum(returned) AS pos
                FROM src, ({edges(f, 5)}) GROUP BY b
            ), ({edges(f, 5)})"""
        )
    base = f"""WITH {_LABELLED_SQL}, bins AS ({" UNION ALL ".join(parts)}),
        rated AS (SELECT *, p / sum(p) OVER (PARTITION BY feature) AS pr,
            n / sum(n) OVER (PARTITION BY feature) AS nr FROM bins)"""
    if report:
        return f"""{base} SELECT feature, CAST(bin_count AS INT) AS bin_count,
            round(sum((pr - nr) * ln(pr / nr)) OVER (PARTITION BY feature) + 1e-11, 8) AS feature_iv,
            bin < 0 AS is_else, round(ln(pr / nr) + 1e-9, 6) AS woe,
            round((pr - nr) * ln(pr / nr) + 1e-11, 8) AS iv, total, CAST(pos AS BIGINT) AS pos_count
            FROM rated"""
    return f"""{base} SELECT feature, CAST(bin AS INT) AS bin, round(right_edge + 1e-6, 3) AS right_edge,
        round(ln(pr / nr) + 1e-9, 6) AS woe,
        (SELECT round(ln(o.pr / o.nr) + 1e-9, 6) FROM rated o
            WHERE o.feature = rated.feature AND o.bin = -1) AS else_woe
        FROM rated WHERE bin >= 0"""


def _labels_sql() -> str:
    shown = """list_transform(e, lambda x: CASE WHEN x = 0 THEN x WHEN abs(x) >= 1 THEN round(x, p)
        ELSE round(x, p - 1 - CAST(floor(log10(abs(x))) AS INT)) END)"""
    probs = ", ".join(f"{i}/6.0" for i in range(7))
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, list_distinct(list_sort(quantile_cont({x}, [{probs}]))) AS e FROM lineitem"
        for name, x in (("small", "l_extendedprice / 1000000"), ("large", "l_extendedprice / 7"))
    )
    return f"""WITH edges AS (SELECT feature, list_sort(e) AS e FROM ({parts})),
        tried AS (SELECT feature, p, {shown} AS r FROM edges, (SELECT CAST(unnest(range(3, 20)) AS INT) AS p)),
        best AS (SELECT feature, arg_min(r, p) AS r FROM tried WHERE len(list_distinct(r)) = len(r) GROUP BY feature)
        SELECT feature, CAST(i AS INT) AS bin, r[i + 2] AS right_edge
        FROM (SELECT feature, r, unnest(range(len(r) - 1)) AS i FROM best)"""


_CURVE_SQL = f"""{_LABELLED_SQL},
    groups AS (SELECT score, sum(returned) AS pos, sum(1 - returned) AS neg FROM src GROUP BY score),
    totals AS (SELECT sum(pos) AS p, sum(neg) AS n FROM groups),
    points AS (SELECT score, pos, neg,
        sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, row_number() OVER w AS rn,
        lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn
        FROM groups WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    kept AS (SELECT score AS threshold, cn / n AS fpr, cp / p AS tpr, cp, cn, rn FROM points, totals
        WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg
        UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0, 0, 0, 0)"""

_HEAD_TARGETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.2)


def _head_sql() -> str:
    values = ", ".join(f"({i}, {t})" for i, t in enumerate(_HEAD_TARGETS))
    return f"""WITH {_CURVE_SQL}, best AS (
        SELECT i, arg_min({{'t': threshold, 'fpr': fpr, 'tpr': tpr, 'cp': cp, 'cn': cn}},
            [abs(fpr - target), CAST(rn AS DOUBLE)]) AS b
        FROM kept, (VALUES {values}) AS targets(i, target) GROUP BY i)
        SELECT 'case_' || i AS name, round(b.t + 1e-12, 9) AS threshold, round(b.fpr + 1e-12, 9) AS fpr,
            CASE WHEN b.cp + b.cn = 0 THEN 0.0 ELSE round(b.cp / (b.cp + b.cn) + 1e-12, 9) END AS "precision",
            round(b.tpr + 1e-12, 9) AS recall FROM best"""


def _bin_report_sql(edges: str) -> str:
    return f"""WITH {_LABELLED_SQL}, edges AS ({edges}),
        totals AS (SELECT sum(returned) AS p, count(*) - sum(returned) AS n, count(*) AS t FROM src),
        binned AS (SELECT len(list_filter(e[2:len(e) - 1], lambda v: v <= score)) AS b,
            min(score) AS lo, max(score) AS hi, sum(returned) AS pos,
            count(*) - sum(returned) AS neg, count(*) AS total, avg(score) AS avg_score
            FROM src, edges GROUP BY b),
        cumulated AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
            row_number() OVER w - 1 AS i FROM binned
            WINDOW w AS (ORDER BY b DESC ROWS UNBOUNDED PRECEDING))
        SELECT 'bin_' || i AS name, round(lo + 1e-12, 9) AS start_value, round(hi + 1e-12, 9) AS end_value,
            CAST(pos AS BIGINT) AS positive, CAST(neg AS BIGINT) AS negative, total,
            round(tp / (tp + fp) + 1e-12, 9) AS "precision", round(tp / p + 1e-12, 9) AS recall,
            round(fp / n + 1e-12, 9) AS false_positive_rate, round(2 * tp / (tp + fp + p) + 1e-12, 9) AS f1_score,
            round(tp / (tp + fp) * t / p + 1e-12, 9) AS lift,
            round(pos / p + 1e-12, 9) AS distribution_of_positive,
            round(neg / n + 1e-12, 9) AS distribution_of_negative,
            round(tp / p + 1e-12, 9) AS cumulative_percent_of_positive,
            round(fp / n + 1e-12, 9) AS cumulative_percent_of_negative,
            round((tp + fp) / t + 1e-12, 9) AS total_cumulative_percent,
            round(tp / p - fp / n + 1e-12, 9) AS ks, round(avg_score + 1e-12, 9) AS avg_score
        FROM cumulated, totals"""


def _bias_sql(edges: str) -> str:
    return f"""WITH {_LABELLED_SQL}, edges AS ({edges}),
        binned AS (SELECT len(list_filter(e[2:len(e) - 1], lambda v: v < score)) AS b,
            avg(score) AS ap, avg(returned) AS al FROM src, edges GROUP BY b)
        SELECT round(e[b + 1] + 1e-11, 8) AS left_endpoint, false AS left_closed,
            round(e[b + 2] + 1e-11, 8) AS right_endpoint, true AS right_closed, false AS is_na,
            round(ap + 1e-11, 8) AS avg_prediction, round(al + 1e-11, 8) AS avg_label,
            round(abs(ap - al) + 1e-11, 8) AS bias
        FROM binned, edges"""


_STUMP_SQL = """WITH src AS (
        SELECT l_extendedprice AS x, l_extendedprice * (1 - l_discount) / 100000 AS y FROM lineitem),
    cuts AS (SELECT unnest(quantile_cont(x, [0, 1/9, 2/9, 3/9, 4/9, 5/9, 6/9, 7/9, 8/9])) AS t FROM src),
    sums AS (SELECT t, sum(0.5 - y) FILTER (WHERE x <= t) AS gl, count(*) FILTER (WHERE x <= t) AS hl,
        sum(0.5 - y) FILTER (WHERE x > t) AS gr, count(*) FILTER (WHERE x > t) AS hr
        FROM src, cuts GROUP BY t),
    best AS (SELECT * FROM sums
        ORDER BY gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr)**2 / (hl + hr + 1) DESC LIMIT 1)
    SELECT round(t + 1e-9, 6) AS threshold, round(-0.3 * gl / (hl + 1) + 1e-9, 6) AS left_value,
        round(-0.3 * gr / (hr + 1) + 1e-9, 6) AS right_value FROM best"""


_EXACT_SQL = """WITH src AS (
        SELECT l_extendedprice, l_tax, l_extendedprice * (1 - l_discount) / 100000 AS y FROM lineitem),
    v AS (SELECT 'l_extendedprice' AS feature, l_extendedprice AS x, sum(0.5 - y) AS g, count(*) AS h FROM src GROUP BY 2
        UNION ALL SELECT 'l_tax', l_tax, sum(0.5 - y), count(*) FROM src GROUP BY 2),
    c AS (SELECT feature, x, sum(g) OVER (PARTITION BY feature ORDER BY x) AS gl, sum(h) OVER (PARTITION BY feature ORDER BY x) AS hl,
        sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM v),
    best AS (SELECT *, gt - gl AS gr, ht - hl AS hr FROM c WHERE hl < ht
        ORDER BY gl * gl / (hl + 1) + (gt - gl)**2 / (ht - hl + 1) - gt**2 / (ht + 1) DESC, feature, x LIMIT 1)
    SELECT 0 AS tree, feature, round(x + 1e-9, 6) AS threshold, round(-0.3 * gl / (hl + 1) + 1e-9, 6) AS left_value,
        round(-0.3 * gr / (hr + 1) + 1e-9, 6) AS right_value FROM best"""


def _rounds_sql(weighted: bool) -> str:
    """Two logistic trees of one split each; cuts are quantiles, weighted by the curvature
    of the round or not."""
    features = ("l_quantity", "l_discount")
    parts = ["r0 AS (SELECT l_quantity, l_discount, CAST(l_extendedprice > 40000 AS INT) AS y, 0.0::DOUBLE AS m FROM lineitem)"]
    for i in (0, 1):
        values = " UNION ALL ".join(
            f"SELECT '{f}' AS f, {f} AS x, sum(p - y) AS g, sum(p * (1 - p)) AS h FROM p{i} GROUP BY {f}" for f in features
        )
        if weighted:
            cuts = f"SELECT f, min(x) AS x FROM c{i}, range(1, 10) t(k) WHERE hl * (1 + 1e-9) >= ht * (k / 10.0) GROUP BY f, k"
        else:
            ninths = ", ".join(f"{k}/9" for k in range(9))
            cuts = " UNION ALL ".join(f"SELECT '{f}', unnest(quantile_cont({f}, [{ninths}])) FROM r0" for f in features)
        side = "CASE f " + " ".join(f"WHEN '{f}' THEN {f}" for f in features) + " END"
        parts += [
            f"p{i} AS (SELECT *, 1 / (1 + exp(-m)) AS p FROM r{i})",
            f"v{i} AS ({values})",
            f"""c{i} AS (SELECT *, sum(g) OVER (PARTITION BY f ORDER BY x) AS gl, sum(h) OVER (PARTITION BY f ORDER BY x) AS hl,
                sum(g) OVER (PARTITION BY f) AS gt, sum(h) OVER (PARTITION BY f) AS ht, max(x) OVER (PARTITION BY f) AS top FROM v{i})""",
            f"q{i}(f, x) AS (SELECT DISTINCT * FROM ({cuts}))",
            f"""b{i} AS (SELECT f, q{i}.x, max_by(gl, c{i}.x) AS gl, max_by(hl, c{i}.x) AS hl, max(gt) AS gt, max(ht) AS ht
                FROM c{i} JOIN q{i} USING (f) WHERE c{i}.x <= q{i}.x AND q{i}.x < top GROUP BY f, q{i}.x),
            t{i} AS (SELECT f, x, -0.3 * gl / (hl + 1) AS vl, -0.3 * (gt - gl) / (ht - hl + 1) AS vr FROM b{i} WHERE hl >= 1 AND ht - hl >= 1
                ORDER BY gl * gl / (hl + 1) + (gt - gl)**2 / (ht - hl + 1) DESC LIMIT 1)""",
            f"r{i + 1} AS (SELECT {', '.join(features)}, y, m + CASE WHEN {side} <= x THEN vl ELSE vr END AS m FROM r{i}, t{i})",
        ]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS tree, f AS feature, round(x + 1e-9, 6) AS threshold, round(vl + 1e-9, 6) AS left_value,"
        f" round(vr + 1e-9, 6) AS right_value FROM t{i}"
        for i in (0, 1)
    )
    return f"WITH {', '.join(parts)} {rows}"


def entry(spark: SparkSession) -> DataFrame:
    return _profile_joined(spark, SMOKE_DIR)


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    scaled = {"prepare": _scaled}
    return {
        "profile_joined": _profile_joined,
        "join_inner_multiway": _join_inner_multiway,
        "join_null_keys": _join_null_keys,
        "join_two_keys": _join_two_keys,
        "join_hot_key": _join_hot_key,
        "feature_filter": _feature_filter,
        "split_train": lambda s, d: _split(s, d, 0, key="o_orderkey"),
        "split_test": lambda s, d: _split(s, d, 1, key="o_orderkey"),
        "split_ordered": lambda s, d: _split(
            s, d, 0, shuffle=False, order_by=["o_custkey", "o_orderkey"], train_size=0.6
        ),
        "split_file_order": _split_file_order,
        "table_statistics": _table_statistics,
        "table_statistics_nulls": _table_statistics_nulls,
        "pearsonr": _pearsonr,
        "pearsonr_constant": _pearsonr_constant,
        "vif": _vif,
        "bin_edges_quantile": _bin_edges_quantile,
        "bin_edges_width": _bin_edges_width,
        "woe_quantile": _woe("quantile"),
        "woe_bucket": _woe("bucket"),
        "woe_labels": _woe_labels,
        "woe_else_bin": _woe_else_bin,
        "woe_report": _woe_report,
        "woe_substitution": _woe_substitution,
        "lr_linear_1f": _lr_linear_1f,
        "lr_linear_predict": _lr_linear_predict,
        "lr_logistic_predict": _predicted(fk.lr_predict, fk.lr_train, max_iter=20, **scaled),
        "gblinear_1f": _gblinear_1f,
        "gblinear_steps": _gblinear_steps,
        "gblinear_predict": _predicted(
            fk.xgb_predict, fk.xgb_train, booster="gblinear", **{"lambda": 0.01}, **scaled
        ),
        "lr_logistic_groups": _lr_logistic_groups,
        "gbdt_stump": _gbdt_stump,
        "gbdt_exact": _gbdt_exact,
        "gbdt_approx": _gbdt_approx,
        "gbdt_two_rounds": _gbdt_two_rounds,
        "rf_determined": _rf_determined,
        "leafwise_three_rounds": _group_means(
            fk.lgbm_train, fk.lgbm_predict, objective="regression", n_estimators=3,
            num_leaves=64, learning_rate=0.5,
        ),
        "dart_group_means": _group_means(
            fk.lgbm_train, fk.lgbm_predict, objective="regression", n_estimators=6,
            num_leaves=64, learning_rate=1.0, boosting_type="dart",
        ),
        "gbdt_group_means": _group_means(
            fk.xgb_train, fk.xgb_predict, objective="reg:squarederror", num_boost_round=1,
            max_depth=16, max_bin=253, learning_rate=1.0, **{"lambda": 0.0},
        ),
        "leafwise_group_means": _group_means(
            fk.lgbm_train, fk.lgbm_predict, objective="regression", n_estimators=1,
            num_leaves=64, learning_rate=1.0,
        ),
        "gbdt_predict": _predicted(fk.xgb_predict, fk.xgb_train, num_boost_round=3, max_depth=3),
        "gbdt_leafwise_predict": _predicted(
            fk.lgbm_predict, fk.lgbm_train, n_estimators=3, num_leaves=8
        ),
        "gbdt_dart_predict": _predicted(
            fk.lgbm_predict, fk.lgbm_train, n_estimators=4, num_leaves=4, boosting_type="dart"
        ),
        "rf_predict": _predicted(
            fk.lgbm_predict, fk.lgbm_train, n_estimators=3, num_leaves=8, boosting_type="rf"
        ),
        "roc_curve": _roc_curve,
        "biclass_summary": _report("summary", 8),
        "biclass_head": _report("head"),
        "biclass_eq_range": _report("eq_range_bins"),
        "biclass_eq_freq": _report("eq_frequent_bins"),
        "bias_equal_width": _bias("equal_width"),
        "bias_equal_freq": _bias("equal_frequency"),
        "csv_roundtrip": _csv_roundtrip,
        "csv_roundtrip_text": _csv_roundtrip_text,
        "chain_join_to_report": _chain_join_to_report,
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _own_queries()
    if llm_queries is not None:
        found |= llm_queries.queries()
        found["pipeline"] = corpus_pipeline.run
    return found


def _own_oracle_sql() -> dict[str, str]:
    numeric = [(c, "float64") for c in _CORRELATED]
    shuffled = "md5('1024|' || o_orderkey)"
    edges = _quantile_edges
    means = """SELECT round(round(avg(l_extendedprice) OVER (PARTITION BY l_quantity), 6) + 1e-6, 3) AS pred,
        l_orderkey AS id, l_linenumber, l_quantity FROM lineitem"""
    regression = """SELECT regr_sxy(l_extendedprice, l_quantity) AS sxy,
        regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS mx,
        avg(l_extendedprice) AS my FROM lineitem"""
    return {
        "profile_joined": _statistics_sql(
            "SELECT o_totalprice, o_orderstatus, c_acctbal, c_nationkey"
            " FROM orders JOIN customer ON o_custkey = c_custkey",
            [
                ("o_totalprice", "float64"),
                ("o_orderstatus", "str"),
                ("c_acctbal", "float64"),
                ("c_nationkey", "int64"),
            ],
        ),
        "join_inner_multiway": """SELECT a.o_orderkey, a.o_totalprice, b.o_orderkey AS order_ref,
            b.o_orderpriority, l_orderkey, l_linenumber, l_quantity
            FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey
            JOIN lineitem ON a.o_orderkey = l_orderkey""",
        "join_null_keys": """SELECT c_custkey, nullif(c_nationkey, 3) AS nation, c_mktsegment, n_name
            FROM customer JOIN nation
            ON nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(n_nationkey, 3)""",
        "join_two_keys": """SELECT a.l_orderkey, a.l_linenumber, a.l_quantity,
            b.l_linenumber AS line, b.l_tax FROM lineitem a JOIN lineitem b
            ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
        "feature_filter": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
        "split_train": _SPLIT_SQL.format(order=shuffled, side="<=", share=0.75),
        "split_test": _SPLIT_SQL.format(order=shuffled, side=">", share=0.75),
        "split_ordered": _SPLIT_SQL.format(order="o_custkey, o_orderkey", side="<=", share=0.6),
        "split_file_order": """SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i,
            count(*) OVER () AS n FROM orders) WHERE i <= floor(n * 0.55)""",
        "table_statistics": _statistics_sql(
            "SELECT * FROM lineitem", [*numeric, ("l_returnflag", "str")]
        ),
        "table_statistics_nulls": _statistics_sql(
            "SELECT nullif(l_quantity, 50) AS l_quantity, nullif(l_returnflag, 'A') AS l_returnflag"
            " FROM lineitem",
            [("l_quantity", "float64"), ("l_returnflag", "str")],
        ),
        "pearsonr": _pearsonr_sql(_CORRELATED, "SELECT * FROM lineitem"),
        "pearsonr_constant": _pearsonr_sql(
            ("l_quantity", "l_tax", "constant"), "SELECT * FROM lineitem", "constant"
        ),
        "vif": f"""WITH src AS (SELECT l_extendedprice AS a, l_discount AS b,
                l_extendedprice * (1 - l_discount) AS c FROM lineitem),
            r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM src),
            d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
            SELECT 'l_extendedprice' AS feature, {_digits_sql("(1 - bc * bc) / det")} AS vif FROM d
            UNION ALL SELECT 'l_discount', {_digits_sql("(1 - ac * ac) / det")} FROM d
            UNION ALL SELECT 'net', {_digits_sql("(1 - ab * ab) / det")} FROM d""",
        "bin_edges_quantile": " UNION ALL ".join(
            f"""SELECT '{f}' AS feature, CAST(i AS INT) AS i, round(e[i + 1] + 1e-9, 6) AS edge FROM
            (SELECT e, unnest(range(len(e))) AS i FROM ({edges(f, 10, "lineitem")}))"""
            for f in ("l_quantity", "l_extendedprice", "l_discount")
        ),
        "bin_edges_width": f"""SELECT 'value' AS feature, CAST(i AS INT) AS i,
            round(e[i + 1] + 1e-9, 6) AS edge FROM
            (SELECT e, unnest(range(len(e))) AS i FROM ({_width_edges("value", 8, "events")}))""",
        "woe_quantile": _woe_sql(["l_quantity", "l_extendedprice"], edges),
        "woe_bucket": _woe_sql(["l_quantity", "l_extendedprice"], _width_edges),
        "woe_labels": _labels_sql(),
        "woe_else_bin": _woe_sql(["quantity_known"], edges),
        "woe_report": _woe_sql(["quantity_known"], edges, report=True),
        "woe_substitution": """SELECT l_orderkey, l_linenumber,
            CAST(CASE WHEN l_extendedprice <= 50000 THEN 1.5 ELSE 2.5 END AS DOUBLE) AS l_extendedprice,
            CAST(CASE WHEN l_quantity = 50 THEN -9.0 WHEN l_quantity <= 10 THEN -0.5
                WHEN l_quantity <= 25.5 THEN 0.125 ELSE 0.75 END AS DOUBLE) AS quantity_known
            FROM lineitem""",
        "lr_linear_1f": f"""SELECT 'l_quantity' AS feature,
            {_digits_sql("sxy / (sxx + 1000)")} AS coefficient,
            {_digits_sql("my - sxy / (sxx + 1000) * mx")} AS intercept FROM ({regression})""",
        "gblinear_1f": f"""SELECT 'l_quantity' AS feature,
            {_digits_sql("sxy / (sxx + 0.5 * n)")} AS coefficient,
            {_digits_sql("my - sxy / (sxx + 0.5 * n) * mx")} AS intercept
            FROM ({regression}), (SELECT count(*) AS n FROM lineitem)""",
        "gblinear_steps": f"""WITH RECURSIVE m AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice / 1000) AS sy,
            sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_extendedprice / 1000) AS sxy FROM lineitem),
            r AS (SELECT 0 AS i, 0.5::DOUBLE AS b, 0.0::DOUBLE AS w UNION ALL
                SELECT i + 1, nb, w + 0.3 * CASE WHEN w - pull / h >= 0 THEN greatest(-(pull + 2.0 * n) / h, -w)
                    ELSE least(-(pull - 2.0 * n) / h, -w) END
                FROM (SELECT *, nb * sx + w * sxx - sxy + 0.5 * n * w AS pull, sxx + 0.5 * n AS h
                    FROM (SELECT *, b - 0.3 * (n * b + w * sx - sy) / n AS nb FROM r, m WHERE i < 7)))
            SELECT i AS rounds, {_digits_sql("w")} AS coefficient, {_digits_sql("b")} AS intercept FROM r WHERE i IN (1, 2, 7)""",
        "lr_linear_predict": f"""SELECT
            round(round(my + sxy / (sxx + 1) * (l_quantity - mx), 6) + 1e-6, 3) AS pred,
            l_orderkey AS "order", l_extendedprice AS price, l_linenumber
            FROM lineitem, ({regression})""",
        "lr_logistic_groups": """SELECT round(round(avg(CAST(l_quantity > 20 AS INT)) OVER (
            PARTITION BY l_returnflag = 'R'), 6) + 1e-8, 5) AS pred, CAST(l_quantity > 20 AS INT) AS many,
            CAST(l_returnflag = 'R' AS INT) AS returned FROM lineitem""",
        "gbdt_stump": _STUMP_SQL,
        "gbdt_exact": _EXACT_SQL,
        "gbdt_approx": _rounds_sql(weighted=True),
        "gbdt_two_rounds": _rounds_sql(weighted=False),
        "rf_determined": """SELECT CAST(l_quantity * l_quantity + 3 AS DOUBLE) AS pred, l_orderkey AS id,
            l_linenumber, l_quantity FROM lineitem""",
        # Each round takes half of what is left of a group's distance from the mean.
        "leafwise_three_rounds": """SELECT round(round(0.125 * avg(l_extendedprice) OVER () + 0.875 *
            avg(l_extendedprice) OVER (PARTITION BY l_quantity), 6) + 1e-6, 3) AS pred, l_orderkey AS id,
            l_linenumber, l_quantity FROM lineitem""",
        # Whatever is dropped, a tree that fits it and the new weights leave the sum as it was.
        "dart_group_means": means,
        "gbdt_group_means": means,
        "leafwise_group_means": means,
        "roc_curve": f"""WITH {_CURVE_SQL} SELECT round(threshold + 1e-12, 9) AS threshold,
            round(fpr + 1e-12, 9) AS fpr, round(tpr + 1e-12, 9) AS tpr FROM kept""",
        "biclass_summary": f"""WITH {_CURVE_SQL} SELECT
            CAST(p + n AS BIGINT) AS total_samples, CAST(p AS BIGINT) AS positive_samples,
            CAST(n AS BIGINT) AS negative_samples,
            round((SELECT sum(neg * (cp - pos / 2.0)) FROM points) / (p * n) + 1e-11, 8) AS auc,
            round((SELECT max(tpr - fpr) FROM kept) + 1e-11, 8) AS ks,
            round((SELECT 2 * sum(returned) / (count(*) + any_value(p)) FROM src, totals
                WHERE score >= 0.5) + 1e-11, 8) AS f1_score FROM totals""",
        "biclass_head": _head_sql(),
        "biclass_eq_range": _bin_report_sql(_width_edges("score", 10)),
        "biclass_eq_freq": _bin_report_sql(edges("score", 10)),
        "bias_equal_width": _bias_sql(_width_edges("score", 8)),
        "bias_equal_freq": _bias_sql(edges("score", 8)),
        "join_hot_key": """SELECT l_orderkey, l_linenumber, l_returnflag, l_returnflag AS flag,
            count(*) OVER (PARTITION BY l_returnflag) AS flag_rows FROM lineitem""",
        "csv_roundtrip_text": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "csv_roundtrip": """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
            c_acctbal, c_mktsegment FROM customer""",
    }


def oracle_sql() -> dict[str, str]:
    found = _own_oracle_sql()
    if llm_queries is not None:
        found |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
