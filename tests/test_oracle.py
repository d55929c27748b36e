import pytest

from checks.compare import differences, oracle_connection
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) == 48


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, oracle, name):
    result = QUERIES[name](spark, SF_DIR)
    assert differences(result.toPandas(), oracle.execute(ORACLE[name]).df()) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
