"""Every registered query against its oracle; ORACLE_SF_DIR picks the data."""

import os

import oracle
import pytest

import __spark_entry__ as contract
from tallybook.contract import ORACLES, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, name):
    got = contract.queries()[name](spark, SF_DIR).toArrow()
    want = con.sql(contract.oracle_sql()[name]).to_arrow_table()
    assert oracle.compare(got, want) is None
