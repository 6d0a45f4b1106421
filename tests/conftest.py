import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    from featurekit import with_roles

    # The numbers, on which known results rest.
    rows = [
        (1, "first", 3.0, "north", 10000.0),
        (2, "second", 4.0, "south", 15000.0),
        (3, "third", 8.0, "south", 25000.0),
        (4, "fourth", 5.0, "west", 10000.0),
    ]
    df = spark.createDataFrame(rows, "ID int, NAME string, AGE double, ADDRESS string, SALARY double")
    return with_roles(df, ids=["ID", "NAME"])


@pytest.fixture
def plant(spark):
    from featurekit import with_roles

    # Fixed values, on which known results rest.
    rows = [
        (8.34, 40.77, 1010.84, 90.01, 480.48, 0),
        (23.64, 58.49, 1011.40, 74.20, 445.75, 1),
        (29.74, 56.90, 1007.15, 41.91, 438.76, 1),
        (19.07, 49.69, 1007.22, 76.79, 453.09, 1),
        (11.80, 40.66, 1017.13, 97.20, 464.43, 0),
    ]
    df = spark.createDataFrame(
        rows, "AT double, V double, AP double, RH double, PE double, RE int"
    )
    return with_roles(df, labels=["RE"])


@pytest.fixture
def scores(spark):
    """165 rows, 66 of them positive, 13 distinct scores up to 0.9."""
    # This block, eleven times.
    pattern = [
        (0, 0.1), (0, 0.15), (0, 0.25), (0, 0.35), (0, 0.45), (0, 0.45), (0, 0.55), (1, 0.65),
        (1, 0.65), (1, 0.75), (1, 0.85), (1, 0.9), (1, 0.9), (0, 0.15), (0, 0.25),
    ]
    return spark.createDataFrame([(float(y), s) for y, s in pattern * 11], "y double, score double")
