import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hirelake.session import tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("hirelake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tuned(session)
    session.stop()


@pytest.fixture
def value(spark):
    """Result of a column expression over one row of named values."""
    def compute(expression, schema=None, **row):
        kinds = schema or ", ".join(f"{name} string" for name in row)
        frame = spark.createDataFrame([tuple(row.values())], kinds)
        return frame.select(expression.alias("v")).first()["v"]

    return compute
