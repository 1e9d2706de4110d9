"""Registered queries against their SQL, and the driver's view of them."""

import pytest
from oracle import connect, difference

import __spark_entry__ as driver
from tagloom.llm.oracles import ORACLES
from tagloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).fetchdf()
    for column in {"refers_to", "form_n"} & set(got.columns):
        got[column] = got[column].astype("Int64")
    assert difference(got, want) is None
