"""Every registered query against its SQL."""

import pytest
from oracle import connect, difference

import __spark_entry__ as driver
from tagloom.plans.oracles import ORACLES as SQL
from tagloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_flagship_has_rows(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, duck.execute(SQL[name]).fetchdf()) is None
