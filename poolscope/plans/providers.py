"""Provider reports: size and width, fees, arrivals, balances by cohort."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import STABLE_SYMBOLS
from ..operators.balances import (
    cohort_label,
    daily_close_value,
    daily_holdings,
    held_intervals,
    held_totals,
    hourly_state,
    net_liquidity_by_day,
    provider_balances,
    tvl_with_price_fallback,
    value_per_liquidity,
)
from ..operators.flows import fee_tally
from ..operators.joins import salted_join
from ..operators.pool import (
    action_counts,
    pool_totals,
    pool_tvl,
    position_boundaries,
    price_boundaries,
    price_range,
    tvl_share,
)
from ..operators.snapshot import first_seen
from ..operators.time import as_date, on_day, timestamp
from ..operators.topk import topk

# Fixed value: the position manager contract, which is not a provider.
POSITION_MANAGER = "0xC36442b4a4522E871399CD717aBDD847Ab11FE88"


def largest_providers(
    positions: DataFrame,
    pool_stats: DataFrame,
    lp_actions: DataFrame,
    as_of: date | str,
    k: int = 3,
    stables: Sequence[str] = STABLE_SYMBOLS,
    true_weighted: bool = False,
    single_price_row: bool = False,
) -> DataFrame:
    """The ``k`` largest providers by value and how wide their price ranges are.

    The weighted width is the *mean* of width times value over the sum of values, as in
    the original, i.e. the weighted mean divided by the number of bands;
    ``true_weighted`` gives the weighted mean itself.
    """

    def today(df: DataFrame) -> DataFrame:
        # only the bands of this day are reported, so the day-grained inputs are cut at the scan
        return on_day(df, "block_timestamp", as_of)

    held = position_boundaries(today(positions))
    bands = tvl_share(
        held,
        pool_tvl(pool_stats, as_of, stables=stables),
        pool_totals(held),
        price_boundaries(today(pool_stats), single_price_row),
        action_counts(today(lp_actions)),
        price_range(pool_stats),
    )
    weighted = F.col("avg_price_rng") * F.col("open_tvl_usd")
    combine = F.sum if true_weighted else F.avg
    per_provider = (
        bands.filter(F.col("open_tvl_usd") > 0)
        .groupBy("liquidity_provider")
        .agg(
            F.avg("avg_price_rng").alias("avg_price_rng"),
            F.try_divide(combine(weighted), F.sum("open_tvl_usd")).alias("tvl_weighted_avg_price_rng"),
            F.sum("open_tvl_usd").alias("curr_tvl_usd"),
        )
    )
    return topk(per_provider, "curr_tvl_usd", k, ["liquidity_provider"])


def fees_by_provider(
    fees: DataFrame,
    since: str = "2021-05-05 12:00:00",
    excluded_provider: str | int = POSITION_MANAGER.lower(),
    token1_amount: str = "amount0_usd",
    dedupe: bool = True,
) -> DataFrame:
    """Fees collected per provider and token, largest first."""
    tally = fee_tally(fees, timestamp(since), token1_amount, dedupe)
    return (
        tally.filter(F.col("liquidity_provider") != F.lit(excluded_provider))
        .groupBy("liquidity_provider", "token")
        .agg(F.sum("token_amount_earned").alias("fees_collected_usd"))
        .orderBy(F.desc_nulls_last("fees_collected_usd"), "liquidity_provider", "token")
    )


def new_providers(positions: DataFrame, pools: DataFrame) -> DataFrame:
    """Providers by the day of their first position, with the liquidity they came with."""
    kept = positions.filter(F.col("is_active") & (F.col("liquidity_adjusted") > 0))
    arrivals = first_seen(positions, "liquidity_provider", "block_timestamp", candidates=kept)
    known = salted_join(
        arrivals, pools.select("pool_address"), ("pool_address",), ("liquidity_provider",), "left_semi"
    )
    return known.groupBy(F.to_date("block_timestamp").alias("block_day")).agg(
        F.sum("liquidity_adjusted").alias("sum_liquidity_adjusted"),
        F.count_distinct("liquidity_provider").alias("cnt"),
    )


def cohort_balances(
    lp_actions: DataFrame,
    pool_stats: DataFrame,
    token_prices: DataFrame,
    pools: DataFrame,
    as_of: date | str,
    spine_start: date | str = "2021-05-01",
    since: str = "2021-05-01 12:00:00",
    cohort_day: date | str = "2021-05-10",
    k: int = 30,
) -> DataFrame:
    """Provider balances per day, split by who led on ``cohort_day`` and who leads on ``as_of``."""
    as_of, cohort_day = as_date(as_of), as_date(cohort_day)
    cutoff = datetime.fromisoformat(since)
    # holdings are dated at midnight, which is never after a cutoff on the same day
    first = cutoff.date() + timedelta(days=1)

    intervals = held_intervals(net_liquidity_by_day(lp_actions), spine_start, as_of)
    holdings = daily_holdings(intervals, first, as_of)
    recent = pool_stats.filter(F.col("block_timestamp") >= timestamp(since))
    hourly = tvl_with_price_fallback(hourly_state(recent, token_prices))
    per_unit = value_per_liquidity(held_totals(intervals, first, as_of), daily_close_value(hourly))
    # unknown pools are dropped here, one row per pool and day, instead of from the holdings
    known = per_unit.join(pools.select("pool_address"), "pool_address", "left_semi")
    daily = provider_balances(holdings, known)

    def leaders(day: date) -> DataFrame:
        # only that day's holdings are expanded and valued
        of_day = provider_balances(daily_holdings(intervals, max(day, first), day), known)
        return topk(of_day, "token_bal_usd", k, ["liquidity_provider"], rank=None)

    # at most k rows each
    return cohort_label(daily, F.broadcast(leaders(cohort_day)), F.broadcast(leaders(as_of)))
