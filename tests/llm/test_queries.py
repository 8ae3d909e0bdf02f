"""Every query that SQL can express, against that SQL over whole tables."""

from __future__ import annotations

import pytest
from compare import differences, oracle_connection

from poolscope.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_matches_sql(spark, name, scale):
    sf_dir = f"/root/testdata/sf{scale}"
    con = oracle_connection(sf_dir)
    problem, rows = differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    con.close()
    assert not problem
    assert rows > 0
