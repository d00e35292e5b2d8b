import pytest

from vitrine.llm.runtime import prepare


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


def make(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
