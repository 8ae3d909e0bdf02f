"""Every registered query against its SQL oracle, on whole tables."""

from __future__ import annotations

import pytest
from compare import differences, oracle_connection

import __spark_entry__ as entry_point

from poolscope.catalog import ENTRIES

NAMES = sorted(ENTRIES)


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def data(request):
    sf_dir = f"/root/testdata/sf{request.param}"
    con = oracle_connection(sf_dir)
    yield sf_dir, con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, data, name):
    sf_dir, con = data
    df = entry_point.queries()[name](spark, sf_dir)
    problem, rows = differences(df, con, entry_point.oracle_sql()[name])
    assert not problem
    assert rows > 0


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry_point.oracle_sql())
    assert set(NAMES) <= set(entry_point.queries())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name", ["market_leaders", "range_response_shares", "largest_providers", "central_band_by_pool", "cohort_balances"]
)
def test_matches_oracle_without_broadcast(spark, no_broadcast, name):
    """The plans used beyond the broadcast threshold give the same rows."""
    sf_dir = "/root/testdata/sf0.01"
    con = oracle_connection(sf_dir)
    df = entry_point.queries()[name](spark, sf_dir)
    problem, _ = differences(df, con, entry_point.oracle_sql()[name])
    assert not problem
