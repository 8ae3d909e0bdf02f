"""Pool reports: value, response to price moves, central band."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import (
    CLASS_LABELS,
    CLASS_LABELS_RANKED,
    CLASS_LABELS_TITLE,
    STABLE_SYMBOLS,
)
from ..operators.bands import central_band, liquidity_at_bounds
from ..operators.pool import (
    action_counts,
    class_share,
    movement_class,
    pool_tvl,
    position_boundaries,
    position_day_totals,
    price_boundaries,
    range_response,
)
from ..operators.shares import share_of_total
from ..operators.time import on_day
from ..operators.topk import topk, topk_per_group


def top_pools_by_class(
    pool_stats: DataFrame, as_of: date | str, k: int = 5, stables: Sequence[str] = STABLE_SYMBOLS
) -> DataFrame:
    """The ``k`` largest pools of each pairing class by value locked."""
    tvl = pool_tvl(pool_stats, as_of, ("pool_name",), stables, CLASS_LABELS_RANKED).select(
        F.col("blk_date").alias("block_day"), "pool_name", "pairing_type", F.col("tvl").alias("avg_tvl")
    )
    best = topk_per_group(tvl, ["pairing_type"], "avg_tvl", k, ["pool_name"])
    return best.orderBy("pairing_type", "rank")


def _of_pools(df: DataFrame, pools: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of a few chosen pools; ``pools`` is a top-k result and therefore broadcast.

    Position, price and action groups all lie within a pool, so this can come first.
    """
    return df.join(F.broadcast(pools.select("pool_address")), "pool_address", how)


def _movement_shares(
    positions: DataFrame,
    pool_stats: DataFrame,
    lp_actions: DataFrame,
    pools: DataFrame,
    single_price_row: bool,
) -> DataFrame:
    # a pool listed twice counts twice
    bands = position_boundaries(_of_pools(positions, pools, "inner"))
    prices = price_boundaries(_of_pools(pool_stats, pools), single_price_row)
    actions = action_counts(_of_pools(lp_actions, pools))
    return class_share(movement_class(range_response(bands, prices, actions)))


def range_response_shares(
    positions: DataFrame,
    pool_stats: DataFrame,
    lp_actions: DataFrame,
    as_of: date | str,
    k: int = 5,
    stables: Sequence[str] = STABLE_SYMBOLS,
    single_price_row: bool = False,
) -> DataFrame:
    """What providers of the ``k`` largest pools did once out of range, averaged per day."""
    pools = topk(pool_tvl(pool_stats, as_of, stables=stables), "tvl", k, ["pool_address"])
    shares = _movement_shares(positions, pool_stats, lp_actions, pools, single_price_row)
    return shares.groupBy("blk_date", "change_that_day").agg(
        F.avg("pct_num_active_lps").alias("pct_num_active_lps_avg"),
        F.avg("pct_min_liquidity_adjusted").alias("pct_min_liquidity_adjusted_avg"),
        F.avg("pct_max_liquidity_adjusted").alias("pct_max_liquidity_adjusted_avg"),
        F.avg("st_price_1_0").alias("st_price_1_0_avg"),
        F.avg("end_price_1_0").alias("end_price_1_0_avg"),
    )


def range_response_by_class(
    positions: DataFrame,
    pool_stats: DataFrame,
    lp_actions: DataFrame,
    as_of: date | str,
    pairing: str = CLASS_LABELS[1],
    k: int = 5,
    stables: Sequence[str] = STABLE_SYMBOLS,
    single_price_row: bool = False,
) -> DataFrame:
    """The same within one pairing class, scaled so that a day's shares add up to 1."""
    tvl = pool_tvl(pool_stats, as_of, stables=stables).filter(F.col("pairing_type") == pairing)
    pools = topk(tvl, "tvl", k, ["pool_address"])
    shares = _movement_shares(positions, pool_stats, lp_actions, pools, single_price_row)
    measures = ("pct_num_active_lps", "pct_min_liquidity_adjusted")
    averages = (
        shares.filter((F.col("pool_num_active_lps") > 0) & (F.col("pool_min_liquidity_adjusted") > 0))
        .groupBy("blk_date", "change_that_day")
        .agg(*[F.avg(m).alias(f"{m}_avg") for m in measures])
    )
    # one row per label and day: a window over a handful of rows
    return share_of_total(averages, ["blk_date"], {f"{m}_avg": f"{m}_avg" for m in measures})


def central_band_by_pool(
    positions: DataFrame,
    pool_stats: DataFrame,
    as_of: date | str,
    k: int = 5,
    trim: float = 0.1,
    stables: Sequence[str] = STABLE_SYMBOLS,
    single_price_row: bool = False,
) -> DataFrame:
    """Price band holding the middle of the liquidity of the ``k`` largest pools per class.

    Only liquidity per band matters here, so of the price rows only their number is used:
    a band counts once per row, as if it had been joined to them.
    """
    tvl = pool_tvl(
        pool_stats,
        as_of,
        ("pool_address", "pool_name", "token0_symbol", "token1_symbol"),
        stables,
        CLASS_LABELS_TITLE,
    )
    best = topk_per_group(tvl, ["pairing_type"], "tvl", k, ["pool_address"])

    def today(df: DataFrame) -> DataFrame:
        return _of_pools(on_day(df, "block_timestamp", as_of), best)

    price_rows = (
        price_boundaries(today(pool_stats), single_price_row)
        .groupBy("pool_address")
        .agg(F.count("*").alias("__copies"))
    )
    # at most k pools per class, each with one count
    copies = best.select("pool_address").join(price_rows, "pool_address", "left")
    counted = position_day_totals(today(positions)).join(F.broadcast(copies), "pool_address")
    bands = counted.withColumn(
        "avg_liquidity", F.col("avg_liquidity") * F.coalesce(F.col("__copies"), F.lit(1))
    )
    keys = ["blk_date", "pool_name"]
    return central_band(liquidity_at_bounds(bands, keys), keys, trim)
