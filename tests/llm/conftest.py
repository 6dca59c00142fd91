from __future__ import annotations

import pytest

from docflow.llm.common import prepared

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)
