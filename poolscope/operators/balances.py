"""Provider balances per day: positions held, hourly pool value, cohorts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import price_status
from ..functions.exact import exact_groups
from .joins import salted_join
from .rolling import running_exact, running_positive
from .snapshot import last_in_bucket
from .time import as_date, expand_days, hour_of

HOLDING = ("liquidity_provider", "pool_address", "pool_name")
_POOL = ("pool_address", "pool_name")


def net_liquidity_by_day(lp_actions: DataFrame) -> DataFrame:
    """Liquidity added minus removed per provider, pool and day, where either has a usd value.

    ``net_liquidity`` is an exact sum, so that taking everything out again leaves zero and not a last bit.
    """
    added = F.col("action") == "INCREASE_LIQUIDITY"
    removed = F.col("action") == "DECREASE_LIQUIDITY"
    usd = F.col("amount0_usd") + F.col("amount1_usd")

    amount = F.col("liquidity_adjusted")
    daily = exact_groups(
        lp_actions.filter(added | removed).withColumn("day", F.to_date("block_timestamp")),
        [*HOLDING, "day"],
        {"net_liquidity": F.when(added, amount).otherwise(-amount)},
        {"total_deposits_usd": F.when(added, usd), "total_withdrawals_usd": F.when(removed, -usd)},
    )
    return daily.filter(F.col("total_deposits_usd").isNotNull() | F.col("total_withdrawals_usd").isNotNull())


def held_intervals(net: DataFrame, start: date | str, as_of: date | str) -> DataFrame:
    """Intervals ``[day, until)`` over which a provider holds a positive balance in a pool.

    A running total only changes on days with an action, so it is taken over those days
    alone; filling the days in between first and windowing over the dense rows gives the
    same balances. Actions outside ``[start, as_of]`` do not count. ``net_liquidity`` is a number or
    an exact sum.
    """
    known = net.filter(
        F.col("day").between(F.lit(as_date(start)), F.lit(as_date(as_of)))
        & F.col("liquidity_provider").isNotNull()
        & F.col("pool_address").isNotNull()
        & F.col("pool_name").isNotNull()
    )
    held = running_positive(known, "net_liquidity", HOLDING, "day", "liquidity_adj", until="until")
    return held.select(*HOLDING, "day", "until", "liquidity_adj")


def daily_holdings(intervals: DataFrame, lo: date | str, hi: date | str) -> DataFrame:
    """One row per provider, pool and day of holding between ``lo`` and ``hi``."""
    renamed = intervals.withColumnRenamed("day", "since_day")
    return expand_days(renamed, "since_day", "until", lo, hi, out="block_day")


def hourly_state(pool_stats: DataFrame, prices: DataFrame) -> DataFrame:
    """Last state of each pool and hour, with the hourly price of both its tokens.

    Prices are looked up for the one surviving row per pool and hour rather than for
    every raw row. ``prices`` has one row per token and hour.
    """
    state = last_in_bucket(
        pool_stats.withColumn("block_hour", hour_of("block_timestamp")),
        ("block_hour", "pool_address", "pool_name"),
        ("block_timestamp", "block_id"),
        (
            "token0_address",
            "token1_address",
            "virtual_reserves_token0_adjusted",
            "virtual_reserves_token1_adjusted",
            "token0_balance_adjusted",
            "token1_balance_adjusted",
            "token0_balance_usd",
            "token1_balance_usd",
            "virtual_liquidity_adjusted",
        ),
    )
    for i in (0, 1):
        known = prices.select(
            F.col("hour").alias("block_hour"),
            F.col("token_address").alias(f"token{i}_address"),
            F.col("price").alias(f"price{i}"),
        )
        state = state.join(known, ["block_hour", f"token{i}_address"], "left")
    return state


def tvl_with_price_fallback(hourly: DataFrame) -> DataFrame:
    """Pool value per hour; a token without a price is valued through the other one.

    The exchange rate then comes from the pool's virtual reserves. Hours without any
    price are dropped.
    """
    reserve0, reserve1 = (F.col(f"virtual_reserves_token{i}_adjusted") for i in (0, 1))
    rate0 = reserve0 * F.pow(reserve1, F.lit(-1.0))
    rate1 = reserve1 * F.pow(reserve0, F.lit(-1.0))
    gross0, gross1 = (F.col(f"token{i}_balance_adjusted") for i in (0, 1))
    price0, price1 = F.col("price0"), F.col("price1")
    status = F.col("price_status")
    tvl = (
        F.when(status == "both prices", price0 * gross0 + price1 * gross1)
        .when(status == "price1", price1 * gross1 + gross0 * rate1 * price1)
        .when(status == "price0", price0 * gross0 + gross1 * rate0 * price0)
    )
    return (
        hourly.withColumn("price_status", price_status("price0", "price1"))
        .filter(status != "no prices")
        .select(
            "block_hour",
            "pool_address",
            "pool_name",
            "price_status",
            (F.col("token0_balance_usd") + F.col("token1_balance_usd")).alias("token_bal_usd"),
            "virtual_liquidity_adjusted",
            tvl.alias("tvl_usd"),
        )
    )


def daily_close_value(hourly_tvl: DataFrame) -> DataFrame:
    """Last known pool value of each day, ignoring hours whose value is NULL or NaN."""
    valid = hourly_tvl.filter(F.col("tvl_usd").isNotNull() & ~F.isnan("tvl_usd"))
    return last_in_bucket(
        valid.withColumn("block_day", F.to_date("block_hour")),
        ("block_day", "pool_address"),
        ("block_hour", "pool_name"),
        ("token_bal_usd", "tvl_usd"),
    )


def held_totals(intervals: DataFrame, lo: date | str, hi: date | str) -> DataFrame:
    """All liquidity held per pool and day between ``lo`` and ``hi``, without a row per holding and day.

    An interval adds its balance on its first day and takes it out on the day it ends. These changes
    are summed per pool and day, exactly, so that what ended leaves nothing behind, and run up over the
    days with a change; only then is a pool's total repeated on the days in between.
    """
    first, last = F.lit(as_date(lo)), F.lit(as_date(hi))
    balance = F.col("liquidity_adj")
    begins = F.struct(F.greatest("day", first).alias("block_day"), balance.alias("change"), F.lit(1.0).alias("held"))
    ends = F.struct(F.greatest("until", first).alias("block_day"), (-balance).alias("change"), F.lit(-1.0).alias("held"))
    both = F.filter(F.array(begins, F.when(F.col("until").isNotNull(), ends)), lambda e: e["block_day"] <= last)
    changes = exact_groups(
        intervals.select(*_POOL, F.inline(both)), [*_POOL, "block_day"], {"change": "change"}, {"held": "held"}
    )
    days = Window.partitionBy(*_POOL).orderBy("block_day")
    series = changes.withColumns({"holders": F.sum("held").over(days), "next_day": F.lead("block_day").over(days)})
    totals = running_exact(series, "change", _POOL, "block_day", "total_liquidity_adj").filter(F.col("holders") > 0)
    spans = totals.select(*_POOL, F.col("block_day").alias("since_day"), "next_day", "total_liquidity_adj")
    return expand_days(spans, "since_day", "next_day", lo, hi, out="block_day")


def value_per_liquidity(held: DataFrame, daily_value: DataFrame) -> DataFrame:
    """Pool value per unit of held liquidity, per day and pool; ``held`` as ``held_totals`` gives it."""
    total = F.col("total_liquidity_adj")
    return held.join(daily_value, ["block_day", "pool_address"], "left").select(
        "block_day",
        "pool_address",
        "pool_name",
        F.coalesce("tvl_usd", F.lit(0.0)).alias("tvl_usd"),
        F.try_divide(F.coalesce("tvl_usd", F.lit(0.0)), total).alias("tvl_usd_per_liquidity"),
        F.coalesce("token_bal_usd", F.lit(0.0)).alias("token_bal_usd"),
        F.try_divide(F.coalesce("token_bal_usd", F.lit(0.0)), total).alias(
            "token_bal_usd_per_liquidity"
        ),
    )


def provider_balances(holdings: DataFrame, per_liquidity: DataFrame) -> DataFrame:
    """Usd balance of each provider and day over all pools with a positive value."""
    valued = per_liquidity.filter(F.col("token_bal_usd_per_liquidity") > 0).select(
        "block_day", "pool_address", "token_bal_usd_per_liquidity"
    )
    joined = salted_join(
        holdings,
        valued,
        ("block_day", "pool_address"),
        spread=("liquidity_provider", "pool_name"),
        how="inner",
    )
    return joined.groupBy("block_day", "liquidity_provider").agg(
        F.sum(F.col("token_bal_usd_per_liquidity") * F.col("liquidity_adj")).alias("token_bal_usd")
    )


# Cohort labels of the report, and the mark shown instead of an address.
COHORT_LABELS = ("Always_Top_30", "Top_30_May10_Only", "Top_30_Today_Only", "Not_Top_30")
HIDDEN_ADDRESS = "_not_"


def cohort_label(
    balances: DataFrame,
    cohort_a: DataFrame,
    cohort_b: DataFrame,
    labels: tuple[str, str, str, str] = COHORT_LABELS,
) -> DataFrame:
    """Balance and providers per day by membership in two top lists.

    ``balances`` has one row per day and provider, a list one row per provider. Only providers in both lists are shown
    by address. A caller that knows the lists to be small may pass them with a broadcast hint.
    """

    def members(cohort: DataFrame, flag: str) -> DataFrame:
        return cohort.select("liquidity_provider", F.lit(True).alias(flag))

    in_a = F.coalesce(F.col("__a"), F.lit(False))
    in_b = F.coalesce(F.col("__b"), F.lit(False))
    always, only_a, only_b, neither = labels
    group = F.when(in_a & in_b, always).when(in_a, only_a).when(in_b, only_b).otherwise(neither)
    shown = F.when(in_a & in_b, F.col("liquidity_provider").cast("string")).otherwise(HIDDEN_ADDRESS)
    return (
        balances.join(members(cohort_a, "__a"), "liquidity_provider", "left")
        .join(members(cohort_b, "__b"), "liquidity_provider", "left")
        .groupBy(
            "block_day", group.alias("liquidity_provider_grp"), shown.alias("top_6_address")
        )
        .agg(
            F.sum("token_bal_usd").alias("token_bal_usd"),
            F.count("liquidity_provider").alias("num_providers"),
        )
        .withColumn("avg_bal_by_lp", F.try_divide("token_bal_usd", "num_providers"))
    )
