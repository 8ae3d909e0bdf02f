"""Small cases with results worked out by hand."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from poolscope import plans
from poolscope.functions.classify import in_range_state, movement_label, pairing_type
from poolscope.functions.stats import coef_var, safe_corr
from poolscope.operators import balances, bands, flows, joins, pool, rolling, shares, snapshot, time, topk
from poolscope.sources.tables import SCHEMAS

D1 = datetime(2024, 1, 1)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def day(n: int) -> date:
    return date(2024, 1, n)


def table(spark, name, records):
    """A table with the declared schema; columns not given are NULL."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in records], schema)


def position(block, lp, liq, lower=1.0, upper=2.0, d=1, token=1, pool_address="p", active=True):
    return {
        "block_id": block, "block_timestamp": datetime(2024, 1, d) + timedelta(seconds=block),
        "pool_address": pool_address, "pool_name": f"name-{pool_address}", "liquidity_provider": lp,
        "nf_token_id": token, "liquidity_adjusted": liq, "price_lower_1_0": lower, "price_upper_1_0": upper,
        "is_active": active,
    }


def stat(block, price, d=1, pool_address="p", usd=(10.0, 10.0), symbols=("USDC", "WETH")):
    return {
        "block_id": block, "block_timestamp": datetime(2024, 1, d) + timedelta(seconds=block),
        "pool_address": pool_address, "pool_name": f"name-{pool_address}", "price_1_0": price,
        "token0_symbol": symbols[0], "token1_symbol": symbols[1], "token0_balance_usd": usd[0],
        "token1_balance_usd": usd[1],
    }


# --- boundaries -------------------------------------------------------------------


def test_boundary_is_found_before_the_liquidity_filter(spark):
    positions = table(
        spark, "positions",
        [position(10, "a", 0.0), position(11, "a", 5.0), position(12, "a", 7.0), position(20, "a", 4.0, d=2)],
    )
    got = rows(pool.position_boundaries(positions), "blk_date", "block_id", "close_liquidity", "open_liquidity")
    assert got == [(day(1), 12, 7.0, 0.0), (day(2), 20, 4.0, 4.0)]


def test_boundary_rows_keep_ties_and_skip_null_keys(spark):
    df = spark.createDataFrame(
        [("a", 1, 2.0), ("a", 1, 3.0), ("a", 5, 4.0), (None, 1, 9.0)], "k string, block long, v double"
    )
    got = rows(snapshot.boundary_rows(df, ["k"], "block", "v", "o", "c"), "block", "o", "c")
    assert got == [(1, 2.0, 0.0), (1, 3.0, 0.0), (5, 0.0, 4.0)]
    flagged = rows(snapshot.flag_boundaries(df, ["k"], "block").filter("k IS NULL"), "is_first", "is_last")
    assert flagged == [(False, False)]


def test_day_totals_average_all_positive_rows(spark):
    positions = table(
        spark, "positions", [position(1, "a", 2.0), position(2, "a", 6.0), position(3, "a", 4.0)]
    )
    got = rows(
        pool.position_day_totals(positions), "open_liquidity", "close_liquidity", "avg_liquidity"
    )
    assert got == [(2.0, 4.0, 4.0)]


def test_price_rows_fan_out_and_test_against_zero(spark):
    positions = table(
        spark, "positions",
        [position(1, "a", 5.0, 4.0, 6.0), position(2, "b", 5.0, 4.0, 9.0, token=2)],
    )
    prices = table(spark, "pool_stats", [stat(1, 5.0), stat(2, 6.5), stat(3, 8.0)])
    acts = pool.action_counts(table(spark, "lp_actions", []))
    response = pool.range_response(pool.position_boundaries(positions), pool.price_boundaries(prices), acts)
    got = rows(response, "liquidity_provider", "close_state", "open_state")
    inside, out = "_in_range_", "_out_of_range_"
    assert got == [("a", out, inside), ("a", out, out), ("b", inside, out), ("b", out, inside)]

    single = pool.price_boundaries(prices, single_price_row=True)
    assert rows(single, "open_price", "close_price") == [(5.0, 8.0)]
    response = pool.range_response(pool.position_boundaries(positions), single, acts)
    assert rows(response, "liquidity_provider", "close_state", "open_state") == [
        ("a", out, inside), ("b", inside, inside),
    ]


# --- flows ------------------------------------------------------------------------


def test_merge_and_rolling_keep_sides_apart(spark):
    b = spark.createDataFrame([(1, "A", 10.0), (3, "A", 5.0)], "d int, s string, v double")
    d = spark.createDataFrame([(1, "A", 100.0), (2, "A", 50.0)], "d int, s string, w double")
    rb = rolling.rolling_rows(b, {"rb": ("v", F.sum)}, ["s"], ["d"], 30).drop("v")
    rd = rolling.rolling_rows(d, {"rd": ("w", F.sum)}, ["s"], ["d"], 30).drop("w")
    got = rows(flows.full_outer_merge(rb, rd, ["d", "s"]), "d", "rb", "rd")
    assert got == [(1, 10.0, 100.0), (2, None, 150.0), (3, 15.0, None)]


def test_ratio_report_divides_by_zero_to_null(spark):
    at = datetime(2024, 1, 2, 5)
    b = table(
        spark, "borrows",
        [{"block_timestamp": at, "borrower": "x", "borrows_contract_symbol": "A", "loan_amount": 1.0,
          "loan_amount_usd": 8.0, "tx_id": "t1"}],
    )
    d = table(
        spark, "deposits",
        [{"block_timestamp": at, "supplier": "y", "supplied_symbol": "A", "supplied_base_asset": 0.0,
          "supplied_base_asset_usd": 0.0, "tx_id": "t2"},
         {"block_timestamp": datetime(2024, 1, 4), "supplier": "y", "supplied_symbol": "A",
          "supplied_base_asset": 3.0, "supplied_base_asset_usd": 3.0, "tx_id": "t3"}],
    )
    got = rows(
        plans.borrow_deposit_ratios(b, d, "2024-01-03"),
        "overall_block_day", "borrowing_as_pct_of_deposits_usd_30day_rolling",
        "avg_borrow_size_usd_30day_rolling", "neg_borrows_usd_30day_rolling_sum",
    )
    assert got == [(day(2), None, 8.0, -8.0)]  # the deposit after as_of does not count


def test_fees_are_merged_over_distinct_totals(spark):
    fees = table(
        spark, "position_collected_fees",
        [{"block_timestamp": D1, "liquidity_provider": lp, "token0_symbol": t0, "token1_symbol": t1,
          "amount0_usd": a, "amount1_usd": b}
         for lp, t0, t1, a, b in [("1", "X", "X", 5.0, 6.0), ("2", "X", "Y", 7.0, None)]],
    )
    got = rows(plans.fees_by_provider(fees, "2023-01-01 00:00:00"))
    assert got == [("1", "X", 5.0), ("2", "X", 7.0), ("2", "Y", 7.0)]
    fixed = plans.fees_by_provider(fees, "2023-01-01 00:00:00", token1_amount="amount1_usd", dedupe=False)
    assert rows(fixed) == [("1", "X", 11.0), ("2", "X", 7.0), ("2", "Y", 0.0)]


def test_equal_totals_merge_whatever_the_order_of_addition(spark):
    fees = table(
        spark, "position_collected_fees",
        [{"block_timestamp": D1, "liquidity_provider": "1", "token0_symbol": t0, "token1_symbol": t1, "amount0_usd": a}
         for t0, t1, a in [("X", "P", 0.1), ("X", "Q", 0.2), ("X", "R", 0.3), ("S", "X", 0.3), ("T", "X", 0.2),
                           ("U", "X", 0.1)]],
    )
    got = {r.token: r.fees_collected_usd for r in plans.fees_by_provider(fees, "2023-01-01 00:00:00").collect()}
    assert got["X"] == 0.6


def test_manager_contract_is_excluded_in_lower_case(spark):
    fees = table(
        spark, "position_collected_fees",
        [{"block_timestamp": datetime(2022, 1, 1), "liquidity_provider": lp, "token0_symbol": "X",
          "token1_symbol": "Y", "amount0_usd": 1.0} for lp in ("0xc36442b4a4522e871399cd717abdd847ab11fe88", "0x1")],
    )
    assert {r.liquidity_provider for r in plans.fees_by_provider(fees).collect()} == {"0x1"}


def test_off_peg_band_is_open(spark):
    at = datetime(2024, 1, 1, 3)
    stats = table(
        spark, "market_stats",
        [{"block_hour": at, "underlying_symbol": s, "token_price": p}
         for s, p in [("DAI", 1.01), ("USDC", 1.02), ("USDT", 0.98), ("ETH", 5.0)]],
    )
    assert rows(plans.off_peg_hours(stats), "underlying_symbol", "avg_token_price") == [
        ("USDC", 1.02), ("USDT", 0.98),
    ]


# --- series -----------------------------------------------------------------------


def test_difference_skips_nulls(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 16.0)], "d int, v double").withColumn("k", F.lit(1))
    assert rows(rolling.diff_prev_nonnull(df, "v", ["k"], "d", "x"), "d", "x") == [(1, None), (2, None), (3, 6.0)]


def test_balances_fill_days_until_zero(spark):
    def act(d, kind, liq, pool_address="p"):
        return {"block_timestamp": datetime(2024, 1, d, 7), "action": f"{kind}_LIQUIDITY", "liquidity_provider": "a",
                "liquidity_adjusted": liq, "pool_address": pool_address, "pool_name": "n", "amount0_usd": 1.0,
                "amount1_usd": 1.0}

    actions = table(
        spark, "lp_actions",
        [act(1, "INCREASE", 10.0), act(3, "DECREASE", 10.0), act(1, "INCREASE", 3.0, "q"), act(9, "INCREASE", 1.0, "r")],
    )
    net = balances.net_liquidity_by_day(actions)
    held = balances.daily_holdings(balances.held_intervals(net, "2024-01-01", "2024-01-04"), "2024-01-01", "2024-01-04")
    got = rows(held, "pool_address", "block_day", "liquidity_adj")
    assert got == [("p", day(1), 10.0), ("p", day(2), 10.0), *[("q", day(i), 3.0) for i in range(1, 5)]]
    one_day = balances.daily_holdings(balances.held_intervals(net, "2024-01-01", "2024-01-04"), "2024-01-02", "2024-01-02")
    assert rows(one_day, "pool_address", "liquidity_adj") == [("p", 10.0), ("q", 3.0)]


def test_taking_everything_out_leaves_nothing(spark):
    """0.1 + 0.2 - 0.3 is not zero in doubles."""
    actions = table(
        spark, "lp_actions",
        [{"block_timestamp": datetime(2024, 1, d), "action": f"{kind}_LIQUIDITY", "liquidity_provider": "a",
          "liquidity_adjusted": liq, "pool_address": "p", "pool_name": "n", "amount0_usd": 1.0, "amount1_usd": 1.0}
         for d, kind, liq in [(1, "INCREASE", 0.1), (2, "INCREASE", 0.2), (3, "DECREASE", 0.3)]],
    )
    held = balances.held_intervals(balances.net_liquidity_by_day(actions), "2024-01-01", "2024-01-09")
    assert rows(held, "day", "until", "liquidity_adj") == [(day(1), day(2), 0.1), (day(2), day(3), 0.3)]


def test_an_action_without_usd_value_does_not_count(spark):
    actions = table(
        spark, "lp_actions",
        [{"block_timestamp": datetime(2024, 1, 1), "action": "INCREASE_LIQUIDITY", "liquidity_provider": lp,
          "liquidity_adjusted": 5.0, "pool_address": "p", "pool_name": "n", "amount0_usd": usd, "amount1_usd": 1.0}
         for lp, usd in [("a", None), ("b", 2.0)]],
    )
    got = rows(balances.net_liquidity_by_day(actions), "liquidity_provider", "total_deposits_usd")
    assert got == [("b", 3.0)]


def test_actions_before_the_spine_do_not_count(spark):
    net = spark.createDataFrame(
        [("a", "p", "n", day(1), 5.0), ("a", "p", "n", day(4), 2.0)],
        "liquidity_provider string, pool_address string, pool_name string, day date, net_liquidity double",
    )
    got = rows(balances.held_intervals(net, "2024-01-02", "2024-01-09"), "day", "until", "liquidity_adj")
    assert got == [(day(4), None, 2.0)]


def test_spine_starts_late_and_ends_at_as_of(spark):
    df = spark.createDataFrame([("a", day(1)), ("b", day(4)), ("c", day(9))], "k string, first date")
    got = rows(time.date_spine(df, "first", "2024-01-03", "2024-01-04"), "k", "day")
    assert got == [("a", day(3)), ("a", day(4)), ("b", day(4))]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hours_do_not_depend_on_the_session_zone(spark, zone):
    # 02:40 on this day does not exist in New York
    df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 40, 59),)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert df.select(time.hour_of("t")).collect()[0][0] == datetime(2024, 3, 10, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lookbacks_end_with_as_of(spark):
    stamps = [datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 31, 23), datetime(2024, 2, 1)]
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    assert [r[0] for r in time.since_days(df, "t", "2024-01-31", 29).collect()] == stamps[1:3]
    assert [r[0] for r in time.since(df, "t", "2024-01-31", "30 days", strict=True).collect()] == stamps[1:3]
    assert [r[0] for r in time.on_day(df, "t", "2024-01-31").collect()] == stamps[2:3]
    assert [r[0] for r in time.since_months(df, "t", "2024-02-01", 1).collect()] == stamps[1:]


@pytest.mark.parametrize("block", [3, 4, 7, 1000])
def test_global_rolling_equals_one_window(spark, block):
    from pyspark.sql import Window

    df = spark.range(60).select(
        (F.col("id") % 7).alias("b"), F.col("id").alias("o"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"),
    )
    one = df.withColumn("x", F.sum("v").over(Window.orderBy("b", "o").rowsBetween(-2, 0)))
    for slice_by in (None, F.floor(F.col("o") / 10)):
        cut = rolling.rolling_rows_global(df, "v", "b", "o", 3, "x", block=block, slice_by=slice_by)
        assert rows(cut, "b", "o", "x") == rows(one, "b", "o", "x")


def test_revenue_frame_spans_markets_unless_partitioned(spark):
    def hour(d, market, reserves):
        return {"block_hour": datetime(2024, 1, d, 1), "underlying_symbol": market, "ctoken_address": "c" + market,
                "token_price": 2.0, "reserves_token_amount": reserves}

    stats = table(
        spark, "market_stats",
        [hour(1, "A", 10.0), hour(2, "A", 11.0), hour(3, "A", 13.0), hour(1, "B", 1.0), hour(2, "B", 4.0)],
    )
    got = rows(plans.reserve_revenue(stats, "2024-01-05", frame=2), "date", "underlying_symbol",
               "revenue_usd_30day_rolling_sum")
    assert got == [(day(1), "A", None), (day(1), "B", None), (day(2), "A", 2.0), (day(2), "B", 8.0), (day(3), "A", 10.0)]
    got = rows(plans.reserve_revenue(stats, "2024-01-05", frame=2, partition_by_market=True), "date",
               "underlying_symbol", "revenue_usd_30day_rolling_sum")
    assert got[-1] == (day(3), "A", 6.0)


# --- top-k ------------------------------------------------------------------------


def test_topk_any_gives_exact_other_rank(spark):
    df = spark.createDataFrame([(1, 9.0, 1.0), (2, 5.0, 9.0), (3, 7.0, 2.0), (4, 1.0, 3.0)], "k int, a double, b double")
    got = rows(topk.topk_any(df, {"ra": "a", "rb": "b"}, 1, ["k"]), "k", "ra", "rb")
    assert got == [(1, 1, 4), (2, 3, 1)]


def test_topk_any_orders_nulls_last_and_ties_by_key(spark):
    df = spark.createDataFrame(
        [(1, 5.0, None), (2, 5.0, None), (3, None, 4.0), (4, None, None), (5, 5.0, 4.0), (6, float("nan"), None)],
        "k int, a double, b double",
    )
    got = rows(topk.topk_any(df, {"ra": "a", "rb": "b"}, 2, ["k"]), "k", "ra", "rb")
    assert got == [(1, 2, 3), (3, 5, 1), (5, 4, 2), (6, 1, 6)]


def test_topk_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "k string, v double")
    assert rows(topk.topk(df, "v", 2, ["k"]), "k", "rank") == [("a", 1), ("b", 2)]
    assert rows(topk.topk(df, "v", 5, ["k"]), "k", "rank") == [("a", 1), ("b", 2), ("c", 3)]
    grouped = df.withColumn("g", F.lit(1))
    assert rows(topk.topk_per_group(grouped, ["g"], "v", 1, ["k"]), "k", "rank") == [("a", 1)]


# --- bands ------------------------------------------------------------------------


def test_central_band_of_two_bands(spark):
    df = spark.createDataFrame(
        [("p", 1.0, 3.0, 2.0), ("p", 2.0, 4.0, 1.0)],
        "pool string, price_lower_1_0 double, price_upper_1_0 double, avg_liquidity double",
    )
    covered = bands.liquidity_at_bounds(df, ["pool"])
    assert rows(covered, "price_bound_1_0", "bound_liquidity", "liquidity_below", "total_liquidity") == [
        (1.0, 2.0, 2.0, 9.0), (2.0, 3.0, 5.0, 9.0), (3.0, 3.0, 8.0, 9.0), (4.0, 1.0, 9.0, 9.0),
    ]
    assert rows(bands.central_band(covered, ["pool"])) == [("p", 1.0, 4.0, 1.0, 0.25)]
    assert rows(bands.central_band(covered, ["pool"], trim=0.25)) == [("p", 2.0, 3.0, 0.5, 1 / 3)]


def test_small_band_survives_next_to_a_huge_one(spark):
    df = spark.createDataFrame(
        [("p", 1.0, 2.0, 1e19), ("p", 3.0, 4.0, 0.25), ("p", 9.0, 8.0, 7.0), ("p", None, 3.5, 1.0)],
        "pool string, price_lower_1_0 double, price_upper_1_0 double, avg_liquidity double",
    )
    got = dict(rows(bands.liquidity_at_bounds(df, ["pool"]), "price_bound_1_0", "bound_liquidity"))
    assert got == {1.0: 1e19, 2.0: 1e19, 3.0: 0.25, 3.5: 0.25, 4.0: 0.25, 8.0: 0.0, 9.0: 0.0}


BIG, TINY = 1e21, 1e-19


def test_sums_take_values_of_any_size(spark):
    from poolscope.functions.exact import exact_sum

    df = spark.createDataFrame(
        [("big", BIG), ("big", BIG), ("tiny", TINY), ("tiny", TINY), ("odd", float("nan")), ("odd", 1.0), ("none", None),
         ("mixed", 0.1), ("mixed", None), ("mixed", 0.2), ("inf", float("inf")), ("gone", BIG), ("gone", -BIG), ("gone", 0.3),
         ("gone", -0.1), ("gone", -0.2)],
        "k string, x double",
    )
    got = dict(rows(df.groupBy("k").agg(exact_sum("x").alias("s")), "k", "s"))
    assert str(got.pop("odd")) == "nan"
    assert got == {"big": 2e21, "tiny": 2e-19, "none": None, "mixed": 0.3, "inf": float("inf"), "gone": 0.0}


@pytest.mark.parametrize("size", [BIG, TINY, 0.1])
def test_balances_of_any_size_end_with_withdrawal(spark, size):
    actions = table(
        spark, "lp_actions",
        [{"block_timestamp": datetime(2024, 1, d), "action": f"{kind}_LIQUIDITY", "liquidity_provider": "a",
          "liquidity_adjusted": liq, "pool_address": "p", "pool_name": "n", "amount0_usd": 1.0, "amount1_usd": 1.0}
         for d, kind, liq in [(1, "INCREASE", size), (3, "DECREASE", size)]],
    )
    held = balances.held_intervals(balances.net_liquidity_by_day(actions), "2024-01-01", "2024-01-09")
    assert rows(held, "day", "until", "liquidity_adj") == [(day(1), day(3), size)]


def test_bands_and_fees_of_any_size(spark):
    df = spark.createDataFrame(
        [("p", 1.0, 2.0, BIG), ("p", 3.0, 4.0, TINY), ("p", 3.0, 5.0, 1 / 3)],
        "pool string, price_lower_1_0 double, price_upper_1_0 double, avg_liquidity double",
    )
    got = dict(rows(bands.liquidity_at_bounds(df, ["pool"]), "price_bound_1_0", "bound_liquidity"))
    assert got[1.0] == got[2.0] == BIG and got[5.0] == pytest.approx(1 / 3, rel=1e-9)
    fees = table(
        spark, "position_collected_fees",
        [{"block_timestamp": D1, "liquidity_provider": "1", "token0_symbol": t, "token1_symbol": "Y", "amount0_usd": a}
         for t, a in [("X", BIG), ("Z", TINY), ("N", float("nan"))]],
    )
    earned = {r.token: r.fees_collected_usd for r in plans.fees_by_provider(fees, "2023-01-01 00:00:00").collect()}
    assert earned["X"] == BIG and earned["Z"] == TINY and str(earned["N"]) == "nan"


def test_slices_never_decrease(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 1e-300, 0.5, 1, 1.001, 2, 1e300, "inf", "nan")], "x double")
    got = [r[0] for r in df.orderBy("x").select(bands.price_slice("x")).collect()]
    assert got == sorted(got)


# --- valuation and cohorts --------------------------------------------------------


def test_price_fallback(spark):
    df = spark.createDataFrame(
        [(i, "p", "n", p0, p1, 4.0, 2.0, 10.0, 6.0, 1.0, 1.0, 1.0)
         for i, (p0, p1) in enumerate([(3.0, 5.0), (3.0, None), (None, 5.0), (None, None)])],
        "block_hour int, pool_address string, pool_name string, price0 double, price1 double, "
        "virtual_reserves_token0_adjusted double, virtual_reserves_token1_adjusted double, "
        "token0_balance_adjusted double, token1_balance_adjusted double, token0_balance_usd double, "
        "token1_balance_usd double, virtual_liquidity_adjusted double",
    )
    got = rows(balances.tvl_with_price_fallback(df), "block_hour", "price_status", "tvl_usd")
    assert got == [(0, "both prices", 60.0), (1, "price0", 66.0), (2, "price1", 55.0)]


def test_daily_close_skips_invalid_values(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1, h), "p", "n", float(h), v) for h, v in [(1, 5.0), (2, float("nan")), (3, None)]],
        "block_hour timestamp_ntz, pool_address string, pool_name string, token_bal_usd double, tvl_usd double",
    )
    assert rows(balances.daily_close_value(df), "token_bal_usd", "tvl_usd") == [(1.0, 5.0)]


def test_last_in_bucket_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None)], "k string, t int, v double")
    assert rows(snapshot.last_in_bucket(df, ["k"], ["t"], ["v"])) == [("a", None)]


def test_cohorts(spark):
    lists = {"a": "ab", "b": "ac"}
    balance = spark.createDataFrame([(day(1), x, 10.0) for x in "abcd"],
                                    "block_day date, liquidity_provider string, token_bal_usd double")
    members = [spark.createDataFrame([(x,) for x in lists[n]], "liquidity_provider string") for n in "ab"]
    got = rows(balances.cohort_label(balance, *members), "liquidity_provider_grp", "top_6_address", "num_providers")
    assert got == [("Always_Top_30", "a", 1), ("Not_Top_30", "_not_", 1), ("Top_30_May10_Only", "_not_", 1),
                   ("Top_30_Today_Only", "_not_", 1)]


def test_tokens_without_a_symbol_are_not_matched(spark):
    """Flows of an unnamed token stay apart, as rows that no join key can match."""
    at = datetime(2024, 1, 1)

    def flow(name, wallet, symbol, amount, usd, records):
        return table(
            spark, name,
            [{"block_timestamp": at, wallet: w, symbol: s, amount: a, usd: u, "tx_id": t}
             for w, s, a, u, t in records],
        )

    b = flow("borrows", "borrower", "borrows_contract_symbol", "loan_amount", "loan_amount_usd",
             [("x", None, 1.0, 10.0, "t1"), ("x", "A", 2.0, 20.0, "t2")])
    d = flow("deposits", "supplier", "supplied_symbol", "supplied_base_asset", "supplied_base_asset_usd",
             [("x", None, 3.0, 30.0, "t3"), ("x", "A", 4.0, 40.0, "t4"), ("y", "A", 1.0, 1.0, "t5")])
    r = flow("repayments", "borrower", "repay_contract_symbol", "repayed_amount", "repayed_amount_usd",
             [("x", "A", 1.0, 5.0, "t6"), ("x", None, 1.0, 5.0, "t7"), ("x", "B", 1.0, 5.0, "t8")])
    empty = [table(spark, n, []) for n in ("liquidations", "redemptions")]
    got = rows(
        plans.whale_interactions(b, d, r, *empty, "2024-01-02", k=1),
        "underlying_symbol", "borrow_amt_usd", "deposit_amt_usd", "net_borrowing", "num_borrows",
        "borrow_total_amt_usd", "deposit_amt_token_order",
    )
    assert got == [("A", 20.0, 40.0, 15.0, 1, 30.0, 1), (None, 10.0, None, None, 1, 30.0, 1),
                   (None, None, 30.0, None, None, 30.0, 1)]
    got = rows(plans.market_leaders(b, d, "2024-01-02", k=1), "underlying_symbol", "borrow_amt_token",
               "deposit_amt_token", "deposit_amt_usd")
    assert got == [("A", 2.0, 4.0, 40.0)]
    got = rows(plans.market_leaders(b, d, "2024-01-02", k=2), "underlying_symbol", "borrow_amt_token",
               "deposit_amt_token")
    assert got == [("A", 2.0, 4.0), (None, 1.0, None), (None, None, 3.0)]


def test_new_providers_need_a_known_pool_and_live_first_position(spark):
    positions = table(
        spark, "positions",
        [position(1, "a", 5.0), position(2, "a", 9.0), position(3, "b", 0.0), position(4, "b", 4.0),
         position(5, "c", 6.0, pool_address="q"), position(6, "d", 2.0, active=False), position(7, "e", 3.0)],
    )
    known = table(spark, "pools", [{"pool_address": "p"}, {"pool_address": "p"}])
    assert rows(plans.new_providers(positions, known)) == [(day(1), 8.0, 2)]


# --- labels and statistics --------------------------------------------------------


def test_pairing_types(spark):
    df = spark.createDataFrame(
        [("USDC", "DAI"), ("USDC", "WETH"), ("WETH", "UNI"), (None, "DAI"), (None, "UNI")],
        "token0_symbol string, token1_symbol string",
    )
    got = [r[0] for r in df.select(pairing_type(labels=("both", "one", "none"))).collect()]
    assert got == ["both", "one", "none", "one", "none"]


def test_range_state_is_closed_and_null_is_out(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 2.0, 2.0), (1.0, 2.0, 2.1), (1.0, 2.0, None)],
                               "l double, u double, p double")
    got = [r[0] for r in df.select(in_range_state("l", "u", "p")).collect()]
    assert got == ["_in_range_", "_in_range_", "_out_of_range_", "_out_of_range_"]


def test_movement_labels_in_order(spark):
    i, o = "_in_range_", "_out_of_range_"
    cases = {
        (o, i, 1.0, 1.0, 1, 1): "Updated_range",
        (o, i, 1.0, 1.0, 0, 1): "Floated_into_range",
        (o, o, 1.0, 1.0, 1, 1): "Still_out_of_range",
        (o, o, 1.0, 0.0, 0, 1): "Reduced_exposure",
        (o, o, 0.0, 1.0, 1, 0): "Other",
        (i, i, 1.0, 1.0, 1, 1): "Other",
        (o, i, 1.0, 0.0, 1, 1): "Other",
    }
    df = spark.createDataFrame(
        list(cases),
        "open_state string, close_state string, open_liquidity double, close_liquidity double, "
        "token_increases long, token_decreases long",
    )
    assert [r[0] for r in df.select(movement_label()).collect()] == list(cases.values())


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 3.0, 7.0), (None, 9.0, 19.0)], "x double, y double, z double")
    got = df.agg(safe_corr("x", "y"), safe_corr("y", "z"), coef_var("x")).collect()[0]
    assert got[0] is None
    assert got[1] == pytest.approx(1.0)
    assert got[2] == 0.0


def test_shares_add_up_either_way(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 0.0)], "g string, i int, v double")
    expected = [("a", 1, 0.25), ("a", 2, 0.75), ("b", 3, None)]
    assert rows(shares.share_of_total(df, ["g"], {"s": "v"}), "g", "i", "s") == expected
    assert rows(shares.share_of_total(df, ["g"], {"s": "v"}, spread=["i"]), "g", "i", "s") == expected


def test_salting_rejects_joins_it_would_change(spark):
    df = spark.range(2)
    with pytest.raises(ValueError):
        joins.salted_join(df, df, ["id"], ["id"], how="full")


def test_width_is_weighted_as_originally_or_truly(spark):
    positions = table(
        spark, "positions",
        [position(1, "a", 1.0, 1.0, 2.0, token=1), position(2, "a", 3.0, 1.0, 5.0, token=2)],
    )
    stats = table(spark, "pool_stats", [stat(1, 1.0), stat(2, 9.0)])
    args = (positions, stats, table(spark, "lp_actions", []), "2024-01-01")
    got = plans.largest_providers(*args, single_price_row=True).collect()[0]
    # widths 1/8 and 4/8, values 5 and 15 of a pool worth 20
    assert (got.avg_price_rng, got.curr_tvl_usd, got["rank"]) == (0.3125, 20.0, 1)
    assert got.tvl_weighted_avg_price_rng == pytest.approx((0.125 * 5 + 0.5 * 15) / 2 / 20)
    true = plans.largest_providers(*args, single_price_row=True, true_weighted=True).collect()[0]
    assert true.tvl_weighted_avg_price_rng == pytest.approx((0.125 * 5 + 0.5 * 15) / 20)
