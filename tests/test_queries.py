"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest
from conftest import MIDDLE

import __spark_entry__ as contract
from registry.compare import differences
from registry.oracles import ORACLES
from registry.queries import QUERIES

NAMES = sorted(QUERIES)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_contract_holds_every_query():
    assert set(NAMES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["client_name", "fund_id"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, MIDDLE)
    assert differences(df, con, contract.oracle_sql()[name]) is None
