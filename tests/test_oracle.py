import pytest

from plandag import queries as relational
from tests.conftest import TESTDATA
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(TESTDATA)


def test_every_query_has_sql():
    assert relational.queries().keys() == relational.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(relational.queries()))
def test_same_as_sql(spark, con, name):
    compare(relational.queries()[name](spark, TESTDATA), con, relational.oracle_sql()[name])
