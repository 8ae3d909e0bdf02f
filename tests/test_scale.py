"""Plans and hot keys: what must hold when the data is large."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from poolscope import plans
from poolscope.catalog import ENTRIES
from poolscope.operators import bands, joins, pool, snapshot, topk
from poolscope.sources.tables import SCHEMAS, read_table
from poolscope.sources.testdata import derived_table

SF = "/root/testdata/sf0.01"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_no_nested_loops_or_cross_products(spark, name):
    plan = physical(ENTRIES[name].run(spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
    assert "Python" not in plan


@pytest.mark.parametrize(
    "name, column",
    [
        ("on_day", "ts"), ("since_days", "o_orderdate"), ("top_pools_by_class", "ts"),
        ("borrow_deposit_ratios", "l_shipdate"),
    ],
)
def test_time_filters_reach_the_scan(spark, name, column):
    d = ENTRIES[name].run(spark, SF)
    scans = re.findall(r"PushedFilters: \[([^\n]*)", d._jdf.queryExecution().toString())
    assert any(f"GreaterThanOrEqual({column}" in s for s in scans)


def test_stored_tables_are_read_with_their_schema_and_pushed_filters(spark, tmp_path):
    derived = derived_table(spark, SF, "market_stats")
    derived.select(*SCHEMAS["market_stats"].names).write.parquet(f"{tmp_path}/market_stats")
    stats = read_table(spark, str(tmp_path), "market_stats")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    report = plans.volatility_and_apy(stats, "2024-01-05", "error", "2024-01-19 15:00:00", "csignup2")
    assert report.count() > 0
    scan = re.search(r"PushedFilters: \[([^\n]*)", report._jdf.queryExecution().toString()).group(1)
    assert "GreaterThanOrEqual(block_hour" in scan
    assert "Not(EqualTo(contract_name" in scan
    read = re.search(r"ReadSchema: ([^\n]*)", report._jdf.queryExecution().toString()).group(1)
    assert "comp_speed" not in read


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_nothing_but_slice_counts_meets_in_one_partition(spark, name):
    counts = physical(ENTRIES[name].run(spark, SF)).count("SinglePartition")
    assert counts <= (1 if name in ("reserve_revenue", "rolling_rows_global") else 0)


def test_topk_per_group_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in physical(ENTRIES["topk_per_group"].run(spark, SF))


def test_global_topk_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in physical(ENTRIES["topk"].run(spark, SF))


def test_rows_of_a_pool_are_cut_before_they_are_shuffled(spark):
    """Only rows of the chosen pools take part in the boundary search."""
    plan = physical(ENTRIES["range_response_shares"].run(spark, SF))
    assert "LeftSemi" in plan


@pytest.fixture(scope="module")
def hot(spark):
    """Positions of which every third row lies in one pool, day and token."""
    n = 60_000
    is_hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.when(is_hot, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 400).cast("string"))).alias("pool"),
        F.when(is_hot, 0).otherwise(F.col("id") % 5000).alias("token"),
        F.col("id").alias("block"),
        (F.col("id") % 97 + 1).cast("double").alias("v"),
    ).repartition(16)


def test_boundaries_of_a_hot_key(spark, hot, no_broadcast):
    per_key = Window.partitionBy("pool", "token")
    literal = (
        hot.withColumn("lo", F.min("block").over(per_key))
        .withColumn("hi", F.max("block").over(per_key))
        .filter((F.col("block") == F.col("lo")) | (F.col("block") == F.col("hi")))
        .select("pool", "token", "block")
    )
    got = snapshot.boundary_rows(hot, ["pool", "token"], "block", "v", "o", "c").select("pool", "token", "block")
    assert got.exceptAll(literal).count() == 0
    assert literal.exceptAll(got).count() == 0


def test_salted_join_spreads_a_hot_key(spark, hot, no_broadcast):
    summary = hot.groupBy("pool").agg(F.sum("v").alias("total"))
    joined = joins.salted_join(hot, summary, ["pool"], ["block"], salts=16)
    assert joined.count() == hot.count()
    plain = hot.join(summary, "pool", "left")
    assert joined.select("block", "total").exceptAll(plain.select("block", "total")).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = Counter(
            {r[0]: r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()}
        )
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # 20,000 rows share one key; unsalted they would be one partition
    assert max(sizes.values()) < 15_000


def test_topk_any_equals_global_windows_on_many_nulls(spark):
    df = spark.range(5000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, (F.col("id") * 7919 % 1009).cast("double")).alias("a"),
        F.when(F.col("id") % 5 < 2, (F.col("id") * 104729 % 613).cast("double")).alias("b"),
    )
    literal = (
        df.withColumn("ra", F.row_number().over(Window.orderBy(F.desc_nulls_last("a"), "k")).cast("long"))
        .withColumn("rb", F.row_number().over(Window.orderBy(F.desc_nulls_last("b"), "k")).cast("long"))
        .filter("ra <= 25 OR rb <= 25")
    )
    got = topk.topk_any(df, {"ra": "a", "rb": "b"}, 25, ["k"]).select(literal.columns)
    assert got.exceptAll(literal).count() == 0
    assert literal.exceptAll(got).count() == 0


def test_one_pool_with_very_many_bounds_is_swept_in_slices(spark):
    n = 4000
    df = spark.range(n).select(
        F.lit("hot").alias("pool"),
        ((F.col("id") * 7919 % n) / 1000.0 + 0.001).alias("price_lower_1_0"),
        ((F.col("id") * 7919 % n) / 1000.0 + 0.001 + (F.col("id") % 50) / 100.0).alias("price_upper_1_0"),
        ((F.col("id") % 13) / 8.0).alias("avg_liquidity"),
    )
    swept = bands.liquidity_at_bounds(df, ["pool"])
    edges = df.selectExpr("price_lower_1_0 AS x").union(df.selectExpr("price_upper_1_0 AS x")).distinct()
    literal = (
        edges.join(df, F.col("x").between(F.col("price_lower_1_0"), F.col("price_upper_1_0")))
        .groupBy("x").agg(F.sum("avg_liquidity").alias("liq"))
    )
    got = swept.select(F.col("price_bound_1_0").alias("x"), F.col("bound_liquidity").alias("liq"))
    assert got.exceptAll(literal).count() == 0
    assert literal.exceptAll(got).count() == 0
    below = swept.withColumn(
        "w", F.sum("bound_liquidity").over(Window.partitionBy("pool").orderBy("price_bound_1_0"))
    ).filter(F.abs(F.col("w") - F.col("liquidity_below")) > 1e-6)
    assert below.count() == 0


def test_class_share_counts_a_provider_once_per_pool(spark):
    movement = spark.createDataFrame(
        [("d", "a", "p", "_out_of_range_", "Other", 1.0, 1.0, 0.0, 2.0),
         ("d", "a", "p", "_out_of_range_", "Still_out_of_range", 3.0, 1.0, 0.0, 2.0),
         ("d", "b", "p", "_out_of_range_", "Other", 4.0, 2.0, 0.0, 2.0),
         ("d", "c", "p", "_in_range_", "Other", 9.0, 9.0, 0.0, 2.0)],
        "blk_date string, liquidity_provider string, pool_name string, open_state string, "
        "change_that_day string, open_liquidity double, close_liquidity double, open_price double, close_price double",
    )
    got = {
        r.change_that_day: (r.pct_num_active_lps, r.pct_min_liquidity_adjusted, r.pct_max_liquidity_adjusted)
        for r in pool.class_share(movement).collect()
    }
    assert got == {"Other": (1.0, 0.625, 0.75), "Still_out_of_range": (0.5, 0.375, 0.25)}


@pytest.mark.parametrize("values", ["CASE WHEN id % 5 = 0 THEN id ELSE NULL END", "1"])
def test_topk_any_counts_rows_without_multiplying_them(spark, values):
    """Most rows NULL, or all tied: the join gives one row per row and measure, and exact ranks."""
    df = spark.range(20000).selectExpr("id AS k", f"CAST({values} AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    found = topk.topk_any(df, {"ra": "a", "rb": "b"}, 50, ["k"])
    by = {c: Window.orderBy(F.col(c).desc_nulls_last(), "k") for c in "ab"}
    literal = df.withColumn("ra", F.row_number().over(by["a"])).withColumn("rb", F.row_number().over(by["b"]))
    wanted = literal.filter("ra <= 50 OR rb <= 50")
    assert sorted(map(tuple, found.select("k", "ra", "rb").collect())) == sorted(
        map(tuple, wanted.select("k", "ra", "rb").collect())
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") >= 1 and "count(1)" in plan


def test_salts_follow_the_partitions(spark, no_broadcast):
    """A key with all rows is cut into parts of about equal size, whatever their number."""
    spark.conf.set("spark.sql.shuffle.partitions", "240")
    try:
        assert joins._default_salts(spark.range(1)) == 80
        big = spark.range(80000).selectExpr("1 AS key", "id AS row")
        salt = F.pmod(F.xxhash64("row"), F.lit(joins._default_salts(big)))
        sizes = [r["count"] for r in big.groupBy(salt.alias("s")).count().collect()]
        assert len(sizes) == 80 and max(sizes) <= 2 * 80000 / 80
        summary = spark.createDataFrame([(1, "one")], "key int, name string")
        assert joins.salted_join(big, summary, ("key",), ("row",)).count() == 80000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_topk_any_evaluates_its_input_once(spark):
    df = spark.range(3000).selectExpr("id % 700 AS k", "CAST(id AS DOUBLE) AS a", "CAST(id * 7 % 31 AS DOUBLE) AS b")
    totals = df.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = topk.topk_any(totals, {"ra": "a", "rb": "b"}, 5, ["k"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("partial_sum(a") == 1 and plan.count("[sum(a") == 1
    assert plan.count("ReusedExchange") >= 3
