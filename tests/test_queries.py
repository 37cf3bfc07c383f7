import pytest

import __spark_entry__ as contract
from catchment.plans.oracles import ORACLES
from catchment.plans.queries import QUERIES
from oracle_check import connect, differences


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    assert differences(df, duck, contract.oracle_sql()[name]) == []


def test_entry(spark):
    ranks = [r["rank"] for r in contract.entry(spark).collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
