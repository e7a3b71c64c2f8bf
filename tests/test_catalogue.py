"""Every query that has a SQL twin gives its rows."""

import pytest
from oracle import connect, same

from folioweave.plans import catalogue

SF = "/root/testdata/sf0.01"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    same(catalogue.queries()[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
