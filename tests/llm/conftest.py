import pytest
from support import odd_documents, rows


@pytest.fixture(scope="session")
def odd(spark):
    return rows(spark, odd_documents()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return rows(spark, [])
