"""Lending-market reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_totals
from ..functions.stats import coef_var, safe_corr
from ..operators.flows import flow_totals, full_outer_merge, off_peg
from ..operators.rolling import diff_prev_nonnull, rolling_rows, rolling_rows_global
from ..operators.time import as_date, since, since_days, timestamp
from ..operators.topk import topk_any


def borrow_deposit_ratios(
    borrows: DataFrame,
    deposits: DataFrame,
    as_of: date | str,
    lookback_days: int = 180,
    frame: int = 30,
) -> DataFrame:
    """Rolling borrow and deposit volumes per symbol and day, and their ratios.

    Each side is rolled over its own days before the sides meet: a day without deposits
    has no deposit figures rather than the last known ones.
    """

    def rolled(df: DataFrame, symbol: str, amount: str, usd: str, user: str, side: str, users: str):
        recent = since_days(df, "block_timestamp", as_of, lookback_days)
        daily = flow_totals(
            recent,
            {"overall_block_day": F.to_date("block_timestamp"), "underlying_symbol": symbol},
            amount,
            usd,
            tx="tx_id",
            user=user,
            count_rows=True,
        )
        measures = {
            f"{side}_usd_30day_rolling_sum": ("amount_usd", F.sum),
            f"dist_num_{side}_30day_rolling_sum": ("dist_num_txs", F.sum),
            f"num_{side}_30day_rolling_sum": ("num_txs", F.sum),
            f"num_{users}_30day_rolling_avg": ("num_users", F.avg),
        }
        series = rolling_rows(daily, measures, ["underlying_symbol"], ["overall_block_day"], frame)
        return series.select("overall_block_day", "underlying_symbol", *measures)

    b = rolled(
        borrows, "borrows_contract_symbol", "loan_amount", "loan_amount_usd", "borrower",
        "borrows", "borrowers",
    )
    d = rolled(
        deposits, "supplied_symbol", "supplied_base_asset", "supplied_base_asset_usd", "supplier",
        "deposits", "depositors",
    )
    keys = ["overall_block_day", "underlying_symbol"]
    interleaved = [c for pair in zip(b.columns[2:], d.columns[2:], strict=True) for c in pair]
    both = full_outer_merge(b, d, keys).select(*keys, *interleaved)
    b_usd, d_usd = "borrows_usd_30day_rolling_sum", "deposits_usd_30day_rolling_sum"
    b_num, d_num = "dist_num_borrows_30day_rolling_sum", "dist_num_deposits_30day_rolling_sum"
    b_who, d_who = "num_borrowers_30day_rolling_avg", "num_depositors_30day_rolling_avg"
    return both.withColumns(
        {
            "borrowing_as_pct_of_deposits_usd_30day_rolling": F.try_divide(b_usd, d_usd),
            "dist_num_of_borrows_as_pct_of_deposits_30day_rolling": F.try_divide(b_num, d_num),
            "avg_num_borrowers_as_pct_of_depositors_30day_rolling": F.try_divide(b_who, d_who),
            f"neg_{b_usd}": -F.col(b_usd),
            f"neg_{b_num}": -F.col(b_num),
            f"neg_{b_who}": -F.col(b_who),
            "avg_deposit_size_usd_30day_rolling": F.try_divide(d_usd, d_num),
            "avg_borrow_size_usd_30day_rolling": F.try_divide(b_usd, b_num),
        }
    )


@dataclass(frozen=True)
class Flow:
    """Where one kind of event keeps its wallet, token, amount and usd value."""

    kind: str
    wallet: str
    symbol: str
    amount: str
    usd: str

    def events(self, df: DataFrame, as_of: date | str, days: int) -> DataFrame:
        return since_days(df, "block_timestamp", as_of, days).select(
            F.lit(self.kind).alias("kind"),
            F.col(self.wallet).alias("address"),
            F.col(self.symbol).alias("underlying_symbol"),
            F.col(self.amount).alias("amount"),
            F.col(self.usd).alias("usd"),
            "tx_id",
        )


BORROWED = Flow("borrow", "borrower", "borrows_contract_symbol", "loan_amount", "loan_amount_usd")
DEPOSITED = Flow(
    "deposit", "supplier", "supplied_symbol", "supplied_base_asset", "supplied_base_asset_usd"
)
REPAID = Flow("repay", "borrower", "repay_contract_symbol", "repayed_amount", "repayed_amount_usd")
LIQUIDATED = Flow(
    "liquidate", "borrower", "liquidation_contract_symbol", "liquidation_amount", "liquidation_amount_usd"
)
REDEEMED = Flow(
    "redeem", "supplier", "recieved_contract_symbol", "recieved_amount", "recieved_amount_usd"
)


def _of(flow: Flow, column: str) -> Column:
    return F.when(F.col("kind") == flow.kind, F.col(column))


def whale_interactions(
    borrows: DataFrame,
    deposits: DataFrame,
    repayments: DataFrame,
    liquidations: DataFrame,
    redemptions: DataFrame,
    as_of: date | str,
    lookback_days: int = 30,
    k: int = 20,
) -> DataFrame:
    """All flows per token of the wallets among the top ``k`` by total borrowed or deposited.

    The wallets are found first. There are at most 2k of them, so they are broadcast and the
    flows are cut to their events at the scan. The flows are then stacked and folded into one
    row per wallet and token, which takes the place of a chain of outer joins.
    """
    tables = {
        BORROWED: borrows, DEPOSITED: deposits, REPAID: repayments, LIQUIDATED: liquidations,
        REDEEMED: redemptions,
    }
    flows = {flow: flow.events(df, as_of, lookback_days) for flow, df in tables.items()}

    per_wallet = exact_totals(
        flows[BORROWED].union(flows[DEPOSITED]),
        ["address"],
        {"borrow_total_amt_usd": _of(BORROWED, "usd"), "deposit_total_amt_usd": _of(DEPOSITED, "usd")},
    )
    whales = topk_any(
        per_wallet,
        {
            "borrow_amt_token_order": "borrow_total_amt_usd",
            "deposit_amt_token_order": "deposit_total_amt_usd",
        },
        k,
        ["address"],
    )

    wallet = whales.columns
    per_kind = (
        reduce(DataFrame.union, flows.values())
        .join(F.broadcast(whales), "address")
        .groupBy(*wallet, "underlying_symbol", "kind")
        .agg(
            F.sum("amount").alias("amount"),
            F.sum("usd").alias("usd"),
            F.count_distinct("tx_id").alias("txs"),
        )
    )
    # flows of an unnamed token are never matched to each other
    apart = F.when(F.col("underlying_symbol").isNull(), F.col("kind")).alias("__apart")

    def value(flow: Flow, column: str, out: str) -> Column:
        return F.max(_of(flow, column)).alias(out)

    folded = (
        per_kind.groupBy(*wallet, "underlying_symbol", apart)
        .agg(
            F.bool_or(F.col("kind").isin(BORROWED.kind, DEPOSITED.kind)).alias("__listed"),
            value(BORROWED, "amount", "borrow_amt_token"),
            value(BORROWED, "usd", "borrow_amt_usd"),
            value(DEPOSITED, "amount", "deposit_amt_token"),
            value(DEPOSITED, "usd", "deposit_amt_usd"),
            value(BORROWED, "txs", "num_borrows"),
            value(DEPOSITED, "txs", "num_deposits"),
            value(REPAID, "amount", "token_repay_amount"),
            value(REPAID, "usd", "loan_repay_amount_usd"),
            value(LIQUIDATED, "amount", "token_liquidation_amount"),
            value(LIQUIDATED, "usd", "loan_liquidation_amount_usd"),
            value(REDEEMED, "amount", "token_redeem_amount"),
            value(REDEEMED, "usd", "loan_redeem_amount_usd"),
            value(REPAID, "txs", "num_repay"),
            value(LIQUIDATED, "txs", "num_liquidations"),
            value(REDEEMED, "txs", "num_redemptions"),
        )
        .filter("__listed")
    )
    return folded.select(
        F.col("address").alias("overall_address"),
        "underlying_symbol",
        *[c for c in folded.columns if c not in (*wallet, "underlying_symbol", "__apart", "__listed")],
        (F.col("borrow_amt_usd") - F.col("loan_repay_amount_usd")).alias("net_borrowing"),
        (F.col("deposit_amt_usd") - F.col("loan_redeem_amount_usd")).alias("net_deposits"),
        F.col("address").alias("symbol_address"),
        "borrow_total_amt_usd",
        "deposit_total_amt_usd",
        "borrow_amt_token_order",
        "deposit_amt_token_order",
    )


def market_leaders(
    borrows: DataFrame,
    deposits: DataFrame,
    as_of: date | str,
    lookback_days: int = 60,
    k: int = 50,
) -> DataFrame:
    """Wallet and token pairs among the top ``k`` by borrowed or by deposited value.

    A side's amounts are shown only if the pair is in that side's top ``k``. Token amounts
    are summed for the at most 2k leading pairs only.
    """
    pair = ["address", "underlying_symbol"]
    unnamed = F.col("address").isNull() | F.col("underlying_symbol").isNull()
    events = (
        BORROWED.events(borrows, as_of, lookback_days)
        .union(DEPOSITED.events(deposits, as_of, lookback_days))
        # the two sides of an unnamed wallet or token are never matched to each other
        .withColumn("__apart", F.when(unnamed, F.col("kind")).otherwise(""))
    )

    def sides(unit: str, column: str) -> dict[str, Column]:
        return {f"{f.kind}_amt_{unit}": _of(f, column) for f in (BORROWED, DEPOSITED)}

    key = [*pair, "__apart"]
    leaders = topk_any(
        exact_totals(events, key, sides("usd", "usd")),
        {f"{f.kind}_amt_token_order": f"{f.kind}_amt_usd" for f in (BORROWED, DEPOSITED)},
        k,
        key,
    )
    listed = leaders.withColumnsRenamed({c: f"__{c}" for c in key})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    found = (
        events.join(F.broadcast(listed), same)
        .groupBy(*key, *[c for c in leaders.columns if c not in key])
        .agg(*[F.sum(amount).alias(name) for name, amount in sides("token", "amount").items()])
    )
    shown = {
        f"{f.kind}_amt_{unit}": F.when(F.col(f"{f.kind}_amt_token_order") <= k, F.col(f"{f.kind}_amt_{unit}"))
        for f in (BORROWED, DEPOSITED)
        for unit in ("token", "usd")
    }
    return found.withColumns(shown).select(
        "underlying_symbol",
        F.col("address").alias("symbol_address"),
        "borrow_amt_token_order",
        "deposit_amt_token_order",
        *shown,
    )


def volatility_and_apy(
    market_stats: DataFrame,
    start: date | str = "2020-12-01",
    excluded_symbol: str = "SAI",
    excluded_hour: str = "2021-03-19 15:00:00",
    excluded_contract: str = "cWBTC2",
) -> DataFrame:
    """Daily level, spread and correlation of rates and prices per symbol.

    The excluded hour is dropped for every market and the excluded contract for every hour.
    """
    kept = market_stats.filter(
        (F.col("block_hour") >= timestamp(as_date(start)))
        & (F.col("underlying_symbol") != excluded_symbol)
        & (F.col("block_hour") != timestamp(excluded_hour))
        & (F.col("contract_name") != excluded_contract)
    )
    mean, spread = F.avg, F.stddev_samp
    return kept.groupBy(F.to_date("block_hour").alias("block_day"), "underlying_symbol").agg(
        mean("supply_apy").alias("avg_supply_apy"),
        spread("supply_apy").alias("std_dev_supply_apy"),
        mean("comp_apy_supply").alias("avg_comp_apy_supply"),
        safe_corr("supply_apy", "borrow_apy").alias("corr_supply_and_borrow_apys"),
        safe_corr("token_price", "borrow_apy").alias("corr_price_and_borrow_apy"),
        (mean("supply_apy") + mean("comp_apy_supply")).alias("net_supply_apy"),
        mean("token_price").alias("avg_token_price"),
        spread("token_price").alias("std_dev_token_price"),
        coef_var("token_price").alias("vari_coef_token_price"),
        mean("ctoken_price").alias("avg_ctoken_price"),
        spread("ctoken_price").alias("std_dev_ctoken_price"),
        coef_var("ctoken_price").alias("vari_coef_ctoken_price"),
        mean("borrow_apy").alias("avg_borrow_apy"),
        spread("borrow_apy").alias("std_dev_borrow_apy"),
        coef_var("borrow_apy").alias("vari_coef_avg_borrow_apy"),
        mean("comp_apy_borrow").alias("avg_comp_apy_borrow"),
        spread("comp_apy_borrow").alias("std_dev_comp_apy_borrow"),
        (mean("borrow_apy") - mean("comp_apy_borrow")).alias("net_borrow_apy"),
    )


def daily_reserves(market_stats: DataFrame, as_of: date | str, lookback: str = "6 months") -> DataFrame:
    """Daily prices, reserves, emissions and reserve change of each market."""
    daily = (
        since(market_stats, "block_hour", as_of, lookback, strict=True)
        .groupBy("underlying_symbol", F.to_date("block_hour").alias("date"), "ctoken_address")
        .agg(
            F.avg("token_price").alias("underlying_token_price"),
            F.avg("ctoken_price").alias("underlying_token_price_c"),
            F.avg("reserves_token_amount").alias("reserves_ctoken"),
            # emissions are reported for one of the two market sides
            (F.sum("comp_speed") * 2).alias("comp_emissions_comp"),
            (F.sum("comp_speed_usd") * 2).alias("comp_emissions_usd"),
        )
        .filter(F.col("ctoken_address").isNotNull())
    )
    change = diff_prev_nonnull(
        daily, "reserves_ctoken", ["ctoken_address"], "date", out="reserve_diff_ctoken"
    )
    return change.withColumn(
        "reserve_diff_usd", F.col("reserve_diff_ctoken") * F.col("underlying_token_price")
    )


def reserve_revenue(
    market_stats: DataFrame,
    as_of: date | str,
    lookback: str = "6 months",
    shown: str = "3 months",
    frame: int = 30,
    partition_by_market: bool = False,
) -> DataFrame:
    """Revenue as the change of market reserves, summed over the last ``frame`` rows.

    The frame runs over *all* markets in order of day and market, as in the original;
    ``partition_by_market`` gives each market its own frame.
    """
    out = "revenue_usd_30day_rolling_sum"
    changes = daily_reserves(market_stats, as_of, lookback)
    recent = since(
        changes.withColumn("date_ts", F.col("date").cast("timestamp_ntz")),
        "date_ts", as_of, shown, strict=True,
    )
    if partition_by_market:
        rolled = rolling_rows(
            recent, {out: ("reserve_diff_usd", F.sum)}, ["ctoken_address"], ["date"], frame
        )
    else:
        rolled = rolling_rows_global(
            recent, "reserve_diff_usd", bucket="date", order="ctoken_address", n=frame, out=out,
            # of hexadecimal addresses: at most 4096 slices per day
            slice_by=F.substring("ctoken_address", 1, 5),
        )
    ordered = rolled.orderBy(F.desc("date"), "underlying_symbol", "ctoken_address")
    return ordered.select("date", "underlying_symbol", out)


def off_peg_hours(
    market_stats: DataFrame,
    symbols: Sequence[str] = ("USDT", "DAI", "USDC"),
    low: float = 0.99,
    high: float = 1.01,
) -> DataFrame:
    """Hours in which a stable token traded away from its peg."""
    return off_peg(market_stats, symbols, low, high)
