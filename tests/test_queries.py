"""Every registered query against its SQL equivalent, on the smallest test tables."""

import math
from pathlib import Path

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as registered  # noqa: E402

TABLES = Path(registered.SMOKE_DIR)
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables not present")
# The optional part's queries have tests of their own.
QUERIES, ORACLES = registered._own_queries(), registered._own_oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _rows(pdf):
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return x if isinstance(x, str) else repr(float(x))

    columns = sorted(pdf.columns)
    return columns, sorted(tuple(map(cell, r)) for r in pdf[columns].itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    got = QUERIES[name](spark, str(TABLES)).toPandas()
    if name in ORACLES:
        assert _rows(got) == _rows(database.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    assert registered.entry(spark).count() == 4
