"""Per-column statistics, Pearson correlation and variance inflation factors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cross_products import correlation_array, correlation_blocks, correlation_rows
from ..functions import cross_products
from ..functions.linear_algebra import inflation_factors
from ..functions.quantiles import COLUMNS_PER_JOB, long_rows, long_sketches, resolve_quantiles, sketch_aggregates
from ..schema import as_double, col, is_missing, type_name
from .project import missing_count, numeric_columns, reject_missing, selected_features

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(cross_products)

# Names of the report's statistics: fixed values.
COUNTS = ("total_count", "count(non-NA count)", "count_na(NA count)")
STATISTICS = (
    "na_ratio",
    "min",
    "max",
    "mean",
    "var(variance)",
    "std(standard deviation)",
    "sem(standard error)",
    "skew",
    "kurtosis",
    "q1(first quartile)",
    "q2(second quartile, median)",
    "q3(third quartile)",
    "moment_2",
    "moment_3",
    "moment_4",
    "central_moment_2",
    "central_moment_3",
    "central_moment_4",
    "sum",
    "sum_2",
    "sum_3",
    "sum_4",
)
QUARTILES = (0.25, 0.5, 0.75)
UNDEFINED_CORRELATION = 999.0
UNDEFINED_VIF = -1.0
# Up to here all pairs fit one compiled aggregation; beyond, vectors are used.
_PAIRWISE_COLUMNS = 8


def _moment_aggregates(columns: Sequence[str]):
    out = []
    for i, name in enumerate(columns):
        x = col(name)
        out += [
            F.sum(x).alias(f"s1_{i}"),
            F.sum(x * x).alias(f"s2_{i}"),
            F.sum(x * x * x).alias(f"s3_{i}"),
            F.sum(x * x * x * x).alias(f"s4_{i}"),
            F.var_pop(x).alias(f"c2_{i}"),
            F.skewness(x).alias(f"c3_{i}"),
            F.kurtosis(x).alias(f"c4_{i}"),
        ]
    return out


def _numeric_statistics(row, i: int, quartiles: Sequence[float]) -> dict[str, float | None]:
    n, m2 = row[f"__n{i}"], row[f"c2_{i}"]
    sums = [row[f"s{k}_{i}"] for k in (1, 2, 3, 4)]
    flat = m2 == 0
    g1 = 0.0 if flat else row[f"c3_{i}"]
    g2 = 0.0 if flat else row[f"c4_{i}"]
    out = {"min": row[f"__lo{i}"], "max": row[f"__hi{i}"], "mean": sums[0] / n}
    variance = m2 * n / (n - 1) if n > 1 else None
    if variance is not None:
        out["var(variance)"] = variance
        out["std(standard deviation)"] = variance**0.5
        out["sem(standard error)"] = (variance / n) ** 0.5
    if n > 2:
        out["skew"] = 0.0 if flat else g1 * (n * (n - 1)) ** 0.5 / (n - 2)
    if n > 3:
        bias = (n - 1) / ((n - 2) * (n - 3))
        out["kurtosis"] = 0.0 if flat else bias * ((n + 1) * g2 + 6)
    out |= dict(zip(STATISTICS[9:12], quartiles))
    for k in (2, 3, 4):
        out[f"moment_{k}"] = sums[k - 1] / n
    out["central_moment_2"] = m2
    out["central_moment_3"] = g1 * m2**1.5
    out["central_moment_4"] = 0.0 if flat else (g2 + 3) * m2 * m2
    out |= {"sum": sums[0], "sum_2": sums[1], "sum_3": sums[2], "sum_4": sums[3]}
    return out


def _wide_statistics(df: DataFrame, numeric: Sequence[str]) -> dict[str, dict]:
    """Rows, known values and statistics per column: three compiled passes."""
    if not numeric:
        return {}
    part = df.select([as_double(df, c) for c in numeric])
    # The sketches are their own pass: next to them the moments would not be compiled.
    row = part.agg(F.count(F.lit(1)).alias("rows"), *_moment_aggregates(numeric)).first().asDict()
    row |= part.agg(*sketch_aggregates(numeric, QUARTILES)).first().asDict()
    return _found_statistics(numeric, row, resolve_quantiles(part, numeric, QUARTILES, row), row["rows"])


def _long_statistics(df: DataFrame, numeric: Sequence[str]) -> dict[str, dict]:
    """The same for many columns: three passes over the table as rows of cells, each grouped by
    column, so the number of scans does not grow with the columns."""
    rows = long_rows(df, numeric)
    moments = rows.groupBy("c").agg(F.count(F.lit(1)).alias("rows"), *_moment_aggregates(["x"])).collect()
    row = long_sketches(rows, QUARTILES)
    row |= {f"{name[:-1]}{r['c']}": r[name] for r in moments for name in r.asDict() if name not in ("c", "rows")}
    total = moments[0]["rows"] if moments else 0
    row |= {f"__n{i}": 0 for i in range(len(numeric)) if f"__n{i}" not in row}
    quartiles = resolve_quantiles(rows, numeric, QUARTILES, row, long=True)
    return _found_statistics(numeric, row, quartiles, total)


def _found_statistics(numeric, row, quartiles, rows: int) -> dict[str, dict]:
    out = {}
    for i, name in enumerate(numeric):
        n = row[f"__n{i}"]
        out[name] = {"rows": rows, "n": n}
        if n:
            out[name] |= _numeric_statistics(row, i, quartiles[name])
    return out


def table_statistics(df: DataFrame, feature_selects: Sequence[str] | None = ()) -> DataFrame:
    """One row per feature with its type, counts, moments and exact quartiles.

    Missing values are left out; bool and text columns have counts only. Three passes,
    whatever the number of columns: moments, quantile sketch, exact quartiles (the last one
    again where a bracket holds very many values), and one for text.
    """
    features = selected_features(df, feature_selects)
    numeric = numeric_columns(df, features)
    if len(numeric) > COLUMNS_PER_JOB:
        found = _long_statistics(df, numeric)
    else:
        found = _wide_statistics(df, numeric)
    others = [c for c in features if c not in numeric]
    if others:
        flags = [is_missing(df, c).alias(f"m{i}") for i, c in enumerate(others)]
        counted = df.select(flags).agg(
            F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"m{i}")).alias(f"m{i}") for i in range(len(others))]
        ).first()
        for i, name in enumerate(others):
            found[name] = {"rows": counted["rows"], "n": counted["rows"] - counted[f"m{i}"]}
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("datatype", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField(c, T.DoubleType()) for c in STATISTICS]
    )
    rows = []
    for name in features:
        s = found[name]
        missing = s["rows"] - s["n"]
        ratio = missing / s["rows"] if s["rows"] else None
        s["na_ratio"] = ratio
        rows.append(
            (name, type_name(df.schema[name].dataType), s["rows"], s["n"], missing)
            + tuple(s.get(c) for c in STATISTICS)
        )
    return df.sparkSession.createDataFrame(rows, schema)


def correlation_matrix(
    df: DataFrame, feature_selects: Sequence[str] | None, operator: str
) -> tuple[list[str], np.ndarray]:
    """Numeric features and their correlations, NaN where one of them is constant.
    Missing cells in any selected column, text included, are an error."""
    selected = selected_features(df, feature_selects)
    features = numeric_columns(df, selected)
    k = len(features)
    x = [F.col(f"__x{i}") for i in range(k)]
    data = df.select(
        *[col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)],
        *[col(c) for c in selected],
    )
    missing = missing_count(df, selected).alias("missing")
    if k > cross_products.BLOCK:
        return features, correlation_array(*_blocks(df, features, selected, operator))
    corr = np.full((k, k), np.nan)
    if k <= _PAIRWISE_COLUMNS:
        pairs = [(i, j) for i in range(k) for j in range(i)]
        row = data.agg(
            missing,
            *[F.var_pop(x[i]).alias(f"v{i}") for i in range(k)],
            *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs],
        ).first()
        reject_missing(row["missing"], operator)
        varying = [i for i in range(k) if row[f"v{i}"]]
        for i, j in pairs:
            if i in varying and j in varying:
                r = row[f"c{i}_{j}"] / (row[f"v{i}"] ** 0.5 * row[f"v{j}"] ** 0.5)
                corr[i, j] = corr[j, i] = min(1.0, max(-1.0, r))
    else:
        row = data.agg(
            missing,
            *[F.avg(x[i]).alias(f"m{i}") for i in range(k)],
            *[F.stddev_pop(x[i]).alias(f"v{i}") for i in range(k)],
        ).first()
        reject_missing(row["missing"], operator)
        varying = [i for i in range(k) if row[f"v{i}"]]
        # Standardised first: the vector routine takes tiny variances for zero.
        scaled = data.select(
            [((x[i] - row[f"m{i}"]) / row[f"v{i}"]).alias(f"z{i}") for i in varying]
        )
        vectors = VectorAssembler(inputCols=scaled.columns, outputCol="z").transform(scaled)
        if len(varying) > 1:
            found = Correlation.corr(vectors, "z").first()[0].toArray()
            corr[np.ix_(varying, varying)] = np.clip(found, -1.0, 1.0)
    for i in varying:
        corr[i, i] = 1.0
    return features, corr


def _blocks(df: DataFrame, features: Sequence[str], selected: Sequence[str], operator: str):
    """Correlations of more columns than one task should hold all pairs of."""
    reject_missing(df.agg(missing_count(df, selected)).first()[0], operator)
    cells = df.select(F.array(*[col(f).cast("double") for f in features]).alias("x"))
    return correlation_blocks(cells, len(features))


def pearsonr(df: DataFrame, feature_selects: Sequence[str] | None = ()) -> DataFrame:
    """Correlation of every pair of numeric features: (feature_a, feature_b, r), 999.0
    where it is undefined. Beyond some hundred features the rows are made in Spark from blocks
    of columns."""
    selected = selected_features(df, feature_selects)
    features = numeric_columns(df, selected)
    if len(features) > cross_products.BLOCK:
        blocks, varies = _blocks(df, features, selected, "pearsonr")
        return correlation_rows(blocks, varies, features, UNDEFINED_CORRELATION)
    features, corr = correlation_matrix(df, feature_selects, "pearsonr")
    rows = [
        (a, b, float(corr[i, j]) if corr[i, j] == corr[i, j] else UNDEFINED_CORRELATION)
        for i, a in enumerate(features)
        for j, b in enumerate(features)
    ]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def pearsonr_wide(df: DataFrame, feature_selects: Sequence[str] | None = ()) -> DataFrame:
    """The same as a square table: a row and a column per feature, in table order."""
    features, corr = correlation_matrix(df, feature_selects, "pearsonr")
    corr = np.where(np.isnan(corr), UNDEFINED_CORRELATION, corr)
    schema = T.StructType(
        [T.StructField("feature", T.StringType())]
        + [T.StructField(f, T.DoubleType()) for f in features]
    )
    rows = [(f, *map(float, corr[i])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, schema)


def vif(df: DataFrame, feature_selects: Sequence[str] | None = ()) -> DataFrame:
    """(feature, vif) of every numeric feature against the others and a constant; -1.0 for
    a constant feature, infinity under exact collinearity."""
    features, corr = correlation_matrix(df, feature_selects, "vif")
    varying = [i for i in range(len(features)) if corr[i, i] == 1.0]
    factors = dict(zip(varying, inflation_factors(corr[np.ix_(varying, varying)])))
    rows = [(f, float(factors.get(i, UNDEFINED_VIF))) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")
