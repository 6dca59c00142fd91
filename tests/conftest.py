from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from docflow import configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("docflow-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def rows(df, *order):
    """Rows as tuples in the order of the given columns."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def values(spark, expression):
    """One value of a column expression."""
    return spark.range(1).select(expression).first()[0]
