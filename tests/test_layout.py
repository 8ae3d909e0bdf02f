"""Laid-out tables give the rows of plain ones, read fewer files and join without exchanges."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from poolscope import plans
from poolscope.operators import pool
from poolscope.operators.time import on_day
from poolscope.sources import layout
from poolscope.sources.testdata import derived_table

SF = "/root/testdata/sf0.001"
NAMES = ("positions", "pool_stats", "lp_actions")
DAY = "2024-01-30"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name in NAMES:
        layout.write_table(derived_table(spark, SF, name), f"laid_{name}", buckets=4, path=f"file://{root}/{name}")
    yield [f"laid_{name}" for name in NAMES]
    for name in NAMES:
        spark.sql(f"DROP TABLE laid_{name}")


def bag(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_those_of_the_plain_table(spark, tables):
    for name, laid in zip(NAMES, tables, strict=True):
        plain = derived_table(spark, SF, name)
        assert bag(layout.read_days(spark, laid, "2023-01-01", "2025-01-01")) == bag(plain)
        assert bag(layout.read_days(spark, laid, DAY, DAY)) == bag(on_day(plain, "block_timestamp", DAY))


def test_days_cut_directories_and_row_groups(spark, tables):
    text = plan(layout.read_days(spark, tables[1], DAY, DAY))
    filters = text[text.index("PartitionFilters") :].split("PushedFilters")
    assert "block_date" in filters[0] and "block_timestamp" in filters[1]


def test_pools_meet_without_exchange(spark, tables, no_broadcast):
    positions, stats, actions = (spark.table(t) for t in tables)
    held = positions.groupBy("pool_address").agg(F.sum("liquidity_adjusted").alias("liquidity"))
    acted = actions.groupBy("pool_address").agg(F.count("*").alias("actions"))
    assert "Exchange" not in plan(held.join(acted, "pool_address"))
    both = positions.join(actions.select("pool_address", "tx_id"), "pool_address")
    assert "Exchange" not in plan(both)
    got = {tuple(r) for r in held.join(acted, "pool_address").collect()}
    plain = [derived_table(spark, SF, n) for n in ("positions", "lp_actions")]
    wanted = plain[0].groupBy("pool_address").agg(F.sum("liquidity_adjusted").alias("liquidity")).join(
        plain[1].groupBy("pool_address").agg(F.count("*").alias("actions")), "pool_address"
    )
    assert {(r[0], round(r[1], 6), r[2]) for r in got} == {(r[0], round(r[1], 6), r[2]) for r in wanted.collect()}


def test_a_report_over_laid_out_tables(spark, tables):
    laid = [layout.read_days(spark, t, "2023-01-01", "2025-01-01") for t in tables]
    plain = [derived_table(spark, SF, n) for n in NAMES]

    def report(inputs):
        return [
            (r["liquidity_provider"], round(r["curr_tvl_usd"], 4)) for r in plans.largest_providers(*inputs, DAY).collect()
        ]

    assert report(laid) == report(plain)
    assert bag(pool.position_day_totals(laid[0]).select("blk_date", "pool_name")) == bag(
        pool.position_day_totals(plain[0]).select("blk_date", "pool_name")
    )


def test_the_day_column_is_reserved(spark):
    with pytest.raises(ValueError, match="block_date"):
        layout.write_table(spark.range(1).withColumn("block_date", F.lit(1)), "laid_none")
