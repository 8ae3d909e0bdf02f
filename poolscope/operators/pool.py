"""Pool state: value, prices, position boundaries, and what providers did."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import (
    CLASS_LABELS,
    IN_RANGE,
    OUT_OF_RANGE,
    STABLE_SYMBOLS,
    in_range_state,
    movement_label,
    pairing_type,
)
from ..functions.fixed import difference, limbs_of, to_double
from .joins import salted_join
from .snapshot import boundary_rows, flag_boundaries, last_in_bucket
from .time import on_day

POSITION_KEYS = ("pool_address", "liquidity_provider", "nf_token_id", "blk_date")
HOLDER = ("liquidity_provider", "nf_token_id")


def pool_tvl(
    pool_stats: DataFrame,
    as_of: date | str,
    keys: Sequence[str] = ("pool_address", "pool_name"),
    stables: Sequence[str] = STABLE_SYMBOLS,
    labels: Sequence[str] = CLASS_LABELS,
) -> DataFrame:
    """Average value locked per pool and pairing class over the rows of one day."""
    value = F.col("token0_balance_usd") + F.col("token1_balance_usd")
    reserves = F.col("virtual_reserves_token0_adjusted") + F.col("virtual_reserves_token1_adjusted")
    return (
        on_day(pool_stats, "block_timestamp", as_of)
        .filter(value.isNotNull())
        .groupBy(
            *keys,
            pairing_type(stables=stables, labels=labels).alias("pairing_type"),
            F.to_date("block_timestamp").alias("blk_date"),
        )
        .agg(
            F.avg(value).alias("tvl"),
            F.avg("virtual_liquidity_adjusted").alias("virtual_liquidity_adjusted"),
            F.avg(reserves).alias("virtual_reserves_adjusted"),
        )
    )


def price_range(pool_stats: DataFrame) -> DataFrame:
    """Highest, lowest and spread of each pool's price over all time."""
    return (
        pool_stats.groupBy("pool_address")
        .agg(F.max("price_1_0").alias("max_price_ever"), F.min("price_1_0").alias("min_price_ever"))
        .withColumn("price_diff", F.abs(F.col("max_price_ever") - F.col("min_price_ever")))
    )


def action_counts(lp_actions: DataFrame) -> DataFrame:
    """Number of liquidity increases and decreases per position and day."""
    return lp_actions.groupBy(
        "pool_address",
        F.to_date("block_timestamp").alias("blk_date"),
        "liquidity_provider",
        "nf_token_id",
    ).agg(
        F.count_if(F.col("action") == "INCREASE_LIQUIDITY").alias("token_increases"),
        F.count_if(F.col("action") == "DECREASE_LIQUIDITY").alias("token_decreases"),
    )


def _position_days(positions: DataFrame) -> DataFrame:
    return positions.select(
        "pool_address",
        "pool_name",
        "nf_token_id",
        "liquidity_provider",
        "price_lower_1_0",
        "price_upper_1_0",
        "block_id",
        "liquidity_adjusted",
        F.to_date("block_timestamp").alias("blk_date"),
    )


def position_boundaries(positions: DataFrame) -> DataFrame:
    """Opening and closing state of each position and day."""
    return boundary_rows(
        _position_days(positions),
        POSITION_KEYS,
        "block_id",
        "liquidity_adjusted",
        "open_liquidity",
        "close_liquidity",
    )


def position_day_totals(positions: DataFrame) -> DataFrame:
    """Opening, closing and average liquidity of each position, band and day."""
    flagged = flag_boundaries(_position_days(positions), POSITION_KEYS, "block_id")
    liquidity = F.col("liquidity_adjusted")
    return (
        flagged.filter(liquidity > 0)
        .groupBy(*POSITION_KEYS, "pool_name", "price_lower_1_0", "price_upper_1_0")
        .agg(
            F.sum(F.when(F.col("is_first"), liquidity).otherwise(0.0)).alias("open_liquidity"),
            F.sum(F.when(F.col("is_last"), liquidity).otherwise(0.0)).alias("close_liquidity"),
            F.avg(liquidity).alias("avg_liquidity"),
        )
    )


def price_boundaries(pool_stats: DataFrame, single_price_row: bool = False) -> DataFrame:
    """Opening and closing price of each pool and day.

    A day has one opening and one closing row, each with price 0 in the other column,
    as the original reports have it. ``single_price_row`` folds them into one row.
    """
    rows = boundary_rows(
        pool_stats.select(
            "pool_address",
            "block_id",
            "price_1_0",
            F.to_date("block_timestamp").alias("blk_date"),
        ),
        ("pool_address", "blk_date"),
        "block_id",
        "price_1_0",
        "open_price",
        "close_price",
    ).select("pool_address", "blk_date", "open_price", "close_price")
    if single_price_row:
        rows = rows.groupBy("pool_address", "blk_date").agg(
            F.max("open_price").alias("open_price"), F.max("close_price").alias("close_price")
        )
    return rows


def _with_states(priced: DataFrame) -> DataFrame:
    return priced.withColumns(
        {
            "close_state": in_range_state("price_lower_1_0", "price_upper_1_0", "close_price"),
            "open_state": in_range_state("price_lower_1_0", "price_upper_1_0", "open_price"),
        }
    )


def _zero_sum(column: str) -> Column:
    return F.sum(F.coalesce(F.col(column), F.lit(0))).alias(column)


def range_response(boundaries: DataFrame, prices: DataFrame, actions: DataFrame) -> DataFrame:
    """Per pool, day, provider and range state at open and close: prices, liquidity, actions.

    Actions are looked up first, because price rows fan positions out.
    """
    acted = boundaries.join(actions, list(POSITION_KEYS), "left")
    return (
        _with_states(salted_join(acted, prices, ("pool_address", "blk_date"), spread=HOLDER))
        .groupBy("pool_name", "blk_date", "liquidity_provider", "close_state", "open_state")
        .agg(
            F.avg("price_lower_1_0").alias("avg_price_lower_1_0"),
            F.avg("price_upper_1_0").alias("avg_price_upper_1_0"),
            F.avg("close_price").alias("close_price"),
            F.avg("open_price").alias("open_price"),
            _zero_sum("close_liquidity"),
            _zero_sum("open_liquidity"),
            _zero_sum("token_increases"),
            _zero_sum("token_decreases"),
        )
    )


def movement_class(response: DataFrame) -> DataFrame:
    """Label each provider's response and total it per label."""
    return (
        response.withColumn("change_that_day", movement_label())
        .groupBy("blk_date", "liquidity_provider", "pool_name", "open_state", "change_that_day")
        .agg(
            F.sum("open_liquidity").alias("open_liquidity"),
            F.sum("close_liquidity").alias("close_liquidity"),
            F.avg("open_price").alias("open_price"),
            F.avg("close_price").alias("close_price"),
        )
    )


def class_share(movement: DataFrame) -> DataFrame:
    """Share of providers and liquidity per pool, day and label, among rows opened out of range.

    Labels and pool totals come from one aggregation over both groupings, so the movements
    are computed once; a window over the few rows of a pool and day then brings them together.
    """
    pool_day = ("blk_date", "pool_name")
    both = (
        movement.filter(F.col("open_state") == OUT_OF_RANGE)
        .groupingSets([[*pool_day, "change_that_day"], pool_day], *pool_day, "change_that_day")
        .agg(
            F.grouping_id().alias("__level"),
            # a provider may appear under two labels, but counts once for the pool
            F.count_distinct("liquidity_provider").alias("n"),
            F.sum("open_liquidity").alias("open"),
            F.sum("close_liquidity").alias("close"),
            F.avg("open_price").alias("st_price_1_0"),
            F.avg("close_price").alias("end_price_1_0"),
        )
    )
    of_pool = Window.partitionBy(*pool_day)
    is_total = F.col("__level") > 0
    named = F.col("blk_date").isNotNull() & F.col("pool_name").isNotNull()

    def total(column: str) -> Column:
        return F.when(named, F.max(F.when(is_total, F.col(column))).over(of_pool))

    return (
        both.withColumns({f"all_{c}": total(c) for c in ("n", "open", "close")})
        .filter(~is_total)
        .select(
            *pool_day,
            "change_that_day",
            F.try_divide("n", "all_n").alias("pct_num_active_lps"),
            F.try_divide("open", "all_open").alias("pct_min_liquidity_adjusted"),
            F.try_divide("close", "all_close").alias("pct_max_liquidity_adjusted"),
            "st_price_1_0",
            "end_price_1_0",
            F.col("all_n").alias("pool_num_active_lps"),
            F.col("all_open").alias("pool_min_liquidity_adjusted"),
        )
    )


def range_shares(response: DataFrame) -> DataFrame:
    """Share of closing liquidity and of providers per pool and day that closed in and out of range.

    A provider with bands of both kinds counts on both sides, but once in the total.
    """
    inside = F.col("close_state") == IN_RANGE
    amount, who = F.col("close_liquidity"), F.col("liquidity_provider")
    per_provider = response.groupBy("blk_date", "pool_name", who).agg(
        F.sum(F.when(inside, amount).otherwise(0.0)).alias("liquidity_in_range"),
        F.sum(F.when(inside, 0.0).otherwise(amount)).alias("liquidity_out_of_range"),
        F.bool_or(inside).alias("in"), F.bool_or(~inside).alias("out"),
    )
    named = F.col("liquidity_provider").isNotNull()
    totals = per_provider.groupBy("blk_date", "pool_name").agg(
        F.sum("liquidity_in_range").alias("liquidity_in_range"),
        F.sum("liquidity_out_of_range").alias("liquidity_out_of_range"),
        F.count_if(named & F.col("in")).alias("num_lps_in_range"),
        F.count_if(named & F.col("out")).alias("num_lps_out_of_range"),
        F.count("liquidity_provider").alias("num_lps"),
    )
    whole = F.col("liquidity_in_range") + F.col("liquidity_out_of_range")
    return totals.withColumns(
        {
            "pct_liquidity_in_range": F.try_divide("liquidity_in_range", whole),
            "pct_liquidity_out_of_range": F.try_divide("liquidity_out_of_range", whole),
            "pct_lps_in_range": F.try_divide("num_lps_in_range", "num_lps"),
            "pct_lps_out_of_range": F.try_divide("num_lps_out_of_range", "num_lps"),
        }
    )


def pool_totals(bands: DataFrame) -> DataFrame:
    """Opening and closing liquidity of each pool and day."""
    return bands.groupBy("blk_date", "pool_address").agg(
        F.sum("open_liquidity").alias("total_open_liquidity"),
        F.sum("close_liquidity").alias("total_close_liquidity"),
    )


def tvl_share(
    bands: DataFrame,
    tvl: DataFrame,
    totals: DataFrame,
    prices: DataFrame,
    actions: DataFrame,
    ranges: DataFrame,
) -> DataFrame:
    """Width and value of each provider's bands: pool value split by share of liquidity.

    ``totals`` are those of ``bands``; for the shares they are matched on the day of ``tvl``,
    not of the band. Everything known per pool and day is gathered first, so the bands are
    shuffled once to meet it.
    """
    per_pool = (
        tvl.select("pool_address", "pairing_type", "tvl", F.col("blk_date").alias("tvl_date"))
        .join(totals.withColumnRenamed("blk_date", "tvl_date"), ["pool_address", "tvl_date"], "left")
        .join(
            ranges.filter(F.col("price_diff") > 0).select("pool_address", "price_diff"),
            "pool_address",
            "left",
        )
        .drop("tvl_date")
    )
    pool_day = ("pool_address", "blk_date")
    per_day = (
        totals.select(*pool_day).join(per_pool, "pool_address").join(prices, list(pool_day), "left")
    )
    acted = bands.join(actions, list(POSITION_KEYS), "left")
    rows = _with_states(salted_join(acted, per_day, pool_day, spread=HOLDER, how="inner"))
    width = F.abs(F.col("price_upper_1_0") - F.col("price_lower_1_0"))

    def worth(liquidity: str, total: str, out: str) -> Column:
        part = F.try_divide(F.coalesce(F.col(liquidity), F.lit(0.0)), F.col(total))
        return F.sum(part * F.col("tvl")).alias(out)

    extra = [_zero_sum("avg_liquidity")] if "avg_liquidity" in bands.columns else []
    return rows.groupBy(
        "pairing_type",
        "pool_name",
        "blk_date",
        "liquidity_provider",
        "price_lower_1_0",
        "price_upper_1_0",
        "close_state",
        "open_state",
    ).agg(
        F.avg(F.try_divide(width, F.col("price_diff"))).alias("avg_price_rng"),
        F.avg("close_price").alias("close_price"),
        F.avg("open_price").alias("open_price"),
        _zero_sum("close_liquidity"),
        _zero_sum("open_liquidity"),
        _zero_sum("token_increases"),
        _zero_sum("token_decreases"),
        worth("close_liquidity", "total_close_liquidity", "close_tvl_usd"),
        worth("open_liquidity", "total_open_liquidity", "open_tvl_usd"),
        *extra,
    )


def fee_growth(pool_stats: DataFrame, counter: str = "fee_growth_global0_x128") -> DataFrame:
    """Growth of a pool's 256-bit fee counter per day: from the last state before the day to its own last state.

    A day's state is its last row, found by an aggregation; only these, one per pool and day, are set side by
    side. The first day of a pool has no growth. The counter may wrap around.
    """
    daily = last_in_bucket(
        pool_stats.withColumn("block_day", F.to_date("block_timestamp")),
        ["pool_address", "block_day"], ["block_timestamp", "block_id"], [counter],
    ).withColumn("__limbs", limbs_of(counter))
    before = F.lag("__limbs").over(Window.partitionBy("pool_address").orderBy("block_day"))
    grown = daily.withColumn("__grown", difference(F.col("__limbs"), before))
    return grown.select("pool_address", "block_day", to_double(F.col("__grown")).alias("fee_growth"))
