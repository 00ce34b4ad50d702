import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("rowmark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A DataFrame from rows, a schema string and consecutive positions."""
    from rowmark import POSITION

    def build(rows, schema, positions=True):
        if positions:
            rows = [(i, *row) for i, row in enumerate(rows)]
            schema = f"{POSITION} BIGINT, {schema}"
        return spark.createDataFrame(rows, schema)

    return build


def values(df, name):
    return [row[name] for row in df.collect()]
