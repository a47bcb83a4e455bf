import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture
def texts(spark):
    """One-column frame of texts, numbered."""

    def make(values, name="t"):
        return spark.createDataFrame(list(enumerate(values)), f"n int, {name} string").coalesce(1)

    return make


@pytest.fixture
def evaluate(texts):
    """Values of a column over texts, in order."""

    def run(values, column):
        from pyspark.sql import functions as F

        rows = texts(values).select("n", column(F.col("t")).alias("v")).orderBy("n").collect()
        return [r["v"] for r in rows]

    return run
