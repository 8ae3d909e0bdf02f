"""Totals of event flows and merging of opposing flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_totals


def flow_totals(
    df: DataFrame,
    keys: dict[str, str | Column],
    amount: str,
    usd: str,
    tx: str | None = None,
    user: str | None = None,
    count_rows: bool = False,
) -> DataFrame:
    """Token and usd sums per key, with optional distinct transaction and user counts.

    ``keys`` maps output names to source columns. Distinct counts are exact. Both kinds of counted
    value go through one shuffle, tagged by kind: rows are folded per (key, kind, value) before it, and a
    kind's remaining rows are its distinct values, so one hot key spreads over the cluster before its
    final count. The sums ride on the rows of the first kind, so no row is multiplied for them.
    """
    groups = [(F.col(src) if isinstance(src, str) else src).alias(out) for out, src in keys.items()]
    counted = {"dist_num_txs": tx, "num_users": user}
    kinds = [(name, src) for name, src in counted.items() if src is not None]
    sums = {"token_amount": F.col(amount), "amount_usd": F.col(usd)}
    if tx is not None and count_rows:
        sums["num_txs"] = F.col(tx).isNotNull().cast("long")
    if not kinds:
        return df.select(*groups, *[c.alias(n) for n, c in sums.items()]).groupBy(*keys).agg(
            *[F.sum(n).alias(n) for n in sums]
        )

    def tagged(k: int) -> Column:
        # a transaction and a user may be of different types; text tells their values apart as well
        value = F.col(kinds[k][1]).cast("string").alias("__value")
        riding = [(c if k == 0 else F.lit(None).cast(df.select(c).schema[0].dataType)).alias(n) for n, c in sums.items()]
        return F.struct(F.lit(k).alias("__kind"), value, *riding)

    each = df.select(*groups, F.inline(F.array(*[tagged(k) for k in range(len(kinds))])))
    folded = each.groupBy(*keys, "__kind", "__value").agg(*[F.sum(n).alias(n) for n in sums])
    known = F.col("__value").isNotNull()
    order = ["token_amount", "amount_usd", "num_users", "dist_num_txs", "num_txs"]
    counts = {name: F.count_if((F.col("__kind") == k) & known) for k, (name, _) in enumerate(kinds)}
    totals = {n: F.coalesce(F.sum(n), F.lit(0)) if n == "num_txs" else F.sum(n) for n in sums} | counts
    return folded.groupBy(*keys).agg(*[totals[n].alias(n) for n in order if n in totals])


def full_outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with each key taken from whichever side has the row."""
    return left.join(right, list(keys), "full")


def off_peg(
    market_stats: DataFrame, symbols: Sequence[str], low: float = 0.99, high: float = 1.01
) -> DataFrame:
    """Hours in which a pegged token's average price left the band ``[low, high]``."""
    hourly = (
        market_stats.filter(F.col("underlying_symbol").isin(*symbols))
        .groupBy("underlying_symbol", "block_hour")
        .agg(F.sum("token_price").alias("token_price"), F.avg("token_price").alias("avg_token_price"))
    )
    price = F.col("avg_token_price")
    return hourly.filter((price > high) | (price < low))


def fee_tally(
    fees: DataFrame,
    since: Column,
    token1_amount: str = "amount0_usd",
    dedupe: bool = True,
) -> DataFrame:
    """Collected fees per (provider, token), each collection counted under both tokens.

    The defaults keep two habits of the original report: the second token is credited
    with the *first* token's amount, and equal totals of one provider and token on
    both sides are merged into one. ``token1_amount='amount1_usd'`` and
    ``dedupe=False`` switch them off.
    """
    def side(token: str, amount: str) -> Column:
        earned = F.coalesce(F.col(amount), F.lit(0.0)).alias("amount")
        return F.struct(F.lit(token).alias("side"), F.col(token).alias("token"), earned)

    both = F.array(side("token0_symbol", "amount0_usd"), side("token1_symbol", token1_amount))
    collected = fees.filter(F.col("block_timestamp") > since).select("liquidity_provider", F.inline(both))
    # exact, because equal totals are merged
    totals = exact_totals(
        collected, ["liquidity_provider", "token", "side"], {"token_amount_earned": "amount"}
    ).drop("side")
    return totals.distinct() if dedupe else totals
