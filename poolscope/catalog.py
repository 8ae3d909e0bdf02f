"""Every report and operator bound to the test data, with its oracle.

An entry runs over whole tables. Doubles are rounded on both sides because the two
engines add in different orders; ``digits`` lists them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from .functions.classify import CLASS_LABELS, in_range_state, pairing_type, recency_bucket
from .functions.exact import exact_totals
from .functions.stats import coef_var, safe_corr
from .operators import balances as bal
from .operators import bands as bnd
from .operators import flows, joins, pool, rolling, shares, snapshot, time, topk
from .sources.testdata import ADAPTERS, derived_table

ORACLES = Path(__file__).resolve().parent.parent / "oracle"

# Dates and constants that fit the test data (it spans other days than real data).
EVENTS_DAY = "2024-01-30"
ORDERS_DAY = "2001-08-01"
EVENTS_START = "2023-12-25"
COHORT_DAY = "2024-01-10"
SPINE_END = "2024-01-20"
CUTOFF = "2024-01-05 12:00:00"
MANAGER = "7"

# Common table expressions shared by oracles, each using only those before it.
FRAGMENTS = (
    "stables", "edge_flags", "edge_bands", "day_bands", "covered", "edge_prices", "day_actions", "pool_value", "price_span",
    "responses", "movements", "class_shares", "net_by_day", "holdings", "hour_state", "hour_value",
    "value_per_unit", "valued_bands",
)

TableReader = Callable[[str], DataFrame]


# A little above one half: an average of cents may lie exactly on a half, and the engines'
# last bits must not decide which way it goes.
_HALF_UP = 0.501


def _rounded(column: str, digits: int) -> Column:
    scale = float(f"1e{digits}")
    return F.floor(F.col(column).cast("double") * scale + _HALF_UP) / scale


def _inputs_of(text: str, swapped: dict[str, str]) -> str:
    """The shared expressions and derived tables an oracle mentions, as a WITH list.

    ``swapped`` names another body for a shared expression.
    """
    used: list[str] = []
    for name in reversed(FRAGMENTS):
        if re.search(rf"\b{name}\b", text):
            body = (ORACLES / "shared" / f"{swapped.get(name, name)}.sql").read_text().strip()
            used.insert(0, f"{name} AS (\n{body}\n)")
            text += body
    tables = [f"{t} AS ({sql})" for t, sql in ADAPTERS.items() if re.search(rf"\b{t}\b", text)]
    return ",\n".join(tables + used)


@dataclass(frozen=True)
class Entry:
    build: Callable[[TableReader], DataFrame]
    digits: dict[str, int] = field(default_factory=dict)
    oracle_of: str = ""
    swapped: dict[str, str] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        @cache
        def table(name: str) -> DataFrame:
            return derived_table(spark, sf_dir, name)

        df = self.build(table)
        return df.withColumns({c: _rounded(c, n) for c, n in self.digits.items()})

    def oracle(self, name: str) -> str:
        text = (ORACLES / f"{self.oracle_of or name}.sql").read_text().strip()
        parts = _inputs_of(text, self.swapped)
        text = f"WITH {parts},\n{text[5:]}" if text.startswith("WITH ") else f"WITH {parts}\n{text}"
        if not self.digits:
            return text
        rounded = ", ".join(
            f"floor(CAST({c} AS DOUBLE) * 1e{n} + {_HALF_UP}) / 1e{n} AS {c}" for c, n in self.digits.items()
        )
        return f"SELECT * REPLACE ({rounded}) FROM (\n{text}\n) AS result"


def _digits(coarse: str = "", fine: str = "") -> dict[str, int]:
    """Sums of large values to 4 digits, ratios and averages to 6."""
    return {**dict.fromkeys(coarse.split(), 4), **dict.fromkeys(fine.split(), 6)}


# --- operators on their own -------------------------------------------------------


def _since_days(t: TableReader) -> DataFrame:
    rows = time.since_days(t("borrows"), "block_timestamp", ORDERS_DAY, 180)
    return rows.select("tx_id", "borrower", "loan_amount_usd")


def _since_months(t: TableReader) -> DataFrame:
    rows = time.since_months(t("deposits"), "block_timestamp", ORDERS_DAY, 6)
    return rows.groupBy("supplied_symbol").agg(
        F.count("*").alias("n"), F.sum("supplied_base_asset").alias("amount")
    )


def _on_day(t: TableReader) -> DataFrame:
    return time.on_day(t("pool_stats"), "block_timestamp", EVENTS_DAY).select(
        "block_id", "pool_name", "price_1_0"
    )


def _date_spine(t: TableReader) -> DataFrame:
    first = (
        t("lp_actions")
        .groupBy("liquidity_provider", "pool_address", "pool_name")
        .agg(F.min(F.to_date("block_timestamp")).alias("min_date"))
    )
    return time.date_spine(first, "min_date", "2024-01-03", EVENTS_DAY).drop("min_date")


def _flow_totals(t: TableReader) -> DataFrame:
    return flows.flow_totals(
        t("deposits"),
        {"block_day": F.to_date("block_timestamp"), "underlying_symbol": "supplied_symbol"},
        "supplied_base_asset",
        "supplied_base_asset_usd",
        tx="tx_id",
        user="supplier",
        count_rows=True,
    )


def _wallet_flow(df: DataFrame, wallet: str, symbol: str, amount: str, usd: str, side: str) -> DataFrame:
    return (
        flows.flow_totals(df, {"address": wallet, "underlying_symbol": symbol}, amount, usd)
        .withColumnsRenamed({"token_amount": f"{side}_token", "amount_usd": f"{side}_usd"})
    )


def _full_outer_merge(t: TableReader) -> DataFrame:
    return flows.full_outer_merge(
        _wallet_flow(
            t("borrows"), "borrower", "borrows_contract_symbol", "loan_amount", "loan_amount_usd", "borrow"
        ),
        _wallet_flow(
            t("repayments"), "borrower", "repay_contract_symbol", "repayed_amount", "repayed_amount_usd",
            "repay",
        ),
        ["address", "underlying_symbol"],
    )


def _daily_prices(t: TableReader) -> DataFrame:
    return (
        t("market_stats")
        .groupBy("underlying_symbol", F.to_date("block_hour").alias("block_day"))
        .agg(F.avg("ctoken_price").alias("ctoken_price"), F.avg("reserves_token_amount").alias("reserves"))
    )


def _rolling_rows(t: TableReader) -> DataFrame:
    measures = {"rolling_sum": ("ctoken_price", F.sum), "rolling_avg": ("ctoken_price", F.avg)}
    series = rolling.rolling_rows(_daily_prices(t), measures, ["underlying_symbol"], ["block_day"], 7)
    return series.select("underlying_symbol", "block_day", *measures)


def _rolling_rows_global(t: TableReader) -> DataFrame:
    # a small block makes even this little data cross block borders
    return rolling.rolling_rows_global(
        _daily_prices(t), "ctoken_price", "block_day", "underlying_symbol", 30, "rolling_sum", block=40
    ).select("block_day", "underlying_symbol", "rolling_sum")


def _diff_prev_nonnull(t: TableReader) -> DataFrame:
    hourly = (
        t("market_stats")
        .groupBy("ctoken_address", "block_hour")
        .agg(F.max("reserves_token_amount").alias("reserves"))
    )
    return rolling.diff_prev_nonnull(hourly, "reserves", ["ctoken_address"], "block_hour", "reserve_diff")


def _intervals(t: TableReader) -> DataFrame:
    return bal.held_intervals(bal.net_liquidity_by_day(t("lp_actions")), EVENTS_START, EVENTS_DAY)


def _holdings(t: TableReader, hi: str = EVENTS_DAY) -> DataFrame:
    return bal.daily_holdings(_intervals(t), EVENTS_START, hi)


def _expand_days(t: TableReader) -> DataFrame:
    """Every day from a provider's first action to the last one."""
    spans = t("lp_actions").groupBy("liquidity_provider").agg(
        F.to_date(F.min("block_timestamp")).alias("first"),
        F.date_add(F.to_date(F.max("block_timestamp")), 1).alias("until"),
    )
    days = time.expand_days(spans, "first", "until", EVENTS_START, EVENTS_DAY, out="block_day")
    return days.select("liquidity_provider", "block_day")


def _topk(t: TableReader) -> DataFrame:
    spent = t("borrows").groupBy("borrower").agg(F.sum("loan_amount_usd").alias("borrowed"))
    return topk.topk(spent, "borrowed", 25, ["borrower"])


def _topk_per_group(t: TableReader) -> DataFrame:
    return topk.topk_per_group(
        t("deposits").select(
            "supplied_symbol", "tx_id", "supplier", "supplied_base_asset_usd", "supplied_base_asset"
        ),
        ["supplied_symbol"],
        "supplied_base_asset_usd",
        10,
        ["tx_id", "supplied_base_asset"],
    )


def _topk_any(t: TableReader) -> DataFrame:
    def total(name: str, value: str, out: str) -> DataFrame:
        return exact_totals(t(name).withColumnRenamed("borrower", "address"), ["address"], {out: value})

    wallets = flows.full_outer_merge(
        total("borrows", "loan_amount_usd", "borrow_usd"),
        total("repayments", "repayed_amount_usd", "repay_usd"),
        ["address"],
    )
    return topk.topk_any(
        wallets, {"borrow_rank": "borrow_usd", "repay_rank": "repay_usd"}, 20, ["address"]
    )


def _boundary_rows(t: TableReader) -> DataFrame:
    return pool.position_boundaries(t("positions"))


def _position_day_totals(t: TableReader) -> DataFrame:
    return pool.position_day_totals(t("positions"))


def _price_boundaries(t: TableReader) -> DataFrame:
    return pool.price_boundaries(t("pool_stats"))


def _outer_day_spine(t: TableReader) -> DataFrame:
    """Days and the providers that had acted by then, with days before any action and providers that came later."""
    actions = t("lp_actions")
    day = F.to_date("block_timestamp")
    firsts = actions.groupBy("liquidity_provider", "pool_address", "pool_name").agg(F.min(day).alias("min_date"))
    start = actions.sparkSession.range(1).select(F.lit(EVENTS_START).cast("date").alias("first"))
    days = time.date_spine(start, "first", EVENTS_START, SPINE_END).drop("first")
    held = firsts.withColumn("until", F.lit(None).cast("date"))
    return joins.outer_range_join(days, held, "day", "min_date", "until", width=7).drop("until")


def _last_in_bucket(t: TableReader, running: Column | None = None) -> DataFrame:
    hourly = t("pool_stats").withColumn("block_hour", time.hour_of("block_timestamp"))
    return snapshot.last_in_bucket(
        hourly,
        ["block_hour", "pool_address", "pool_name"],
        ["block_timestamp", "block_id"],
        ["price_1_0", "token0_balance_usd"],
        running,
    )


def _running_last(t: TableReader) -> DataFrame:
    rows = t("pool_stats").select("block_id", "block_timestamp", "pool_address", "token0_balance_usd")
    read = snapshot.running_last(
        rows, ["pool_address"], ["block_timestamp", "block_id"], ["token0_balance_usd"], F.to_date("block_timestamp"), True
    )
    return read.drop("block_timestamp")


def _first_seen(t: TableReader) -> DataFrame:
    return snapshot.first_seen(t("positions"), "liquidity_provider", "block_timestamp").select(
        "liquidity_provider", "block_id", "pool_name", "liquidity_adjusted"
    )


def _stats(t: TableReader, **columns) -> DataFrame:
    return (
        t("market_stats")
        .groupBy("underlying_symbol", F.to_date("block_hour").alias("block_day"))
        .agg(*[c.alias(n) for n, c in columns.items()])
    )


def _share_of_total(t: TableReader) -> DataFrame:
    per_provider = (
        t("positions")
        .groupBy("pool_name", "liquidity_provider")
        .agg(F.sum("liquidity_adjusted").alias("liquidity"))
    )
    return shares.share_of_total(
        per_provider, ["pool_name"], {"share": "liquidity"}, spread=["liquidity_provider"]
    )


def _pairing_type(t: TableReader) -> DataFrame:
    return t("pool_stats").select("block_id", pairing_type().alias("pairing_type"))


def _in_range_state(t: TableReader) -> DataFrame:
    rows = t("positions").join(t("pool_stats").select("block_id", "price_1_0"), "block_id")
    rows = rows.withColumn("price", F.col("price_1_0") * F.pmod("block_id", F.lit(4)))
    return rows.select(
        "block_id", in_range_state("price_lower_1_0", "price_upper_1_0", "price").alias("state")
    )


def _response(t: TableReader) -> DataFrame:
    return pool.range_response(
        pool.position_boundaries(t("positions")),
        pool.price_boundaries(t("pool_stats")),
        pool.action_counts(t("lp_actions")),
    )


def _recency(t: TableReader) -> DataFrame:
    dated = t("borrows").withColumn("num_days_since", recency_bucket("block_timestamp", ORDERS_DAY))
    return dated.groupBy("num_days_since", "borrows_contract_symbol").agg(
        F.sum("loan_amount_usd").alias("loan_amount_usd"), F.count("tx_id").alias("num_txs")
    )


def _tvl_share(t: TableReader) -> DataFrame:
    bands = pool.position_boundaries(t("positions"))
    return pool.tvl_share(
        bands,
        pool.pool_tvl(t("pool_stats"), EVENTS_DAY),
        pool.pool_totals(bands),
        pool.price_boundaries(t("pool_stats")),
        pool.action_counts(t("lp_actions")),
        pool.price_range(t("pool_stats")),
    )


def _bounds(t: TableReader) -> DataFrame:
    bands = pool.position_day_totals(t("positions"))
    return bnd.liquidity_at_bounds(bands, ["blk_date", "pool_name"])


def _hourly_tvl(t: TableReader) -> DataFrame:
    return bal.tvl_with_price_fallback(
        bal.hourly_state(t("pool_stats"), t("token_prices_hourly"))
    ).drop("virtual_liquidity_adjusted")


def _value_per_liquidity(t: TableReader) -> DataFrame:
    held = bal.held_totals(_intervals(t), EVENTS_START, EVENTS_DAY)
    return bal.value_per_liquidity(held, bal.daily_close_value(_hourly_tvl(t)))


def _daily_provider_value(t: TableReader) -> DataFrame:
    return (
        t("lp_actions")
        .groupBy(F.to_date("block_timestamp").alias("block_day"), "liquidity_provider")
        .agg(F.sum("amount0_usd").alias("token_bal_usd"))
    )


def _cohort_label(t: TableReader) -> DataFrame:
    daily = _daily_provider_value(t)

    def leaders(day: str) -> DataFrame:
        on_that_day = daily.filter(F.col("block_day") == F.lit(day).cast("date"))
        return topk.topk(on_that_day, "token_bal_usd", 30, ["liquidity_provider"], rank=None)

    return bal.cohort_label(daily, F.broadcast(leaders(COHORT_DAY)), F.broadcast(leaders(EVENTS_DAY)))


def _fee_tally(t: TableReader) -> DataFrame:
    return flows.fee_tally(t("position_collected_fees"), time.timestamp(CUTOFF))


OPERATORS: dict[str, Entry] = {
    "since_days": Entry(_since_days, _digits("loan_amount_usd")),
    "since_months": Entry(_since_months, _digits("amount")),
    "on_day": Entry(_on_day, _digits("price_1_0")),
    "date_spine": Entry(_date_spine),
    "flow_totals": Entry(_flow_totals, _digits("token_amount amount_usd")),
    "full_outer_merge": Entry(
        _full_outer_merge, _digits("borrow_token borrow_usd repay_token repay_usd")
    ),
    "rolling_rows": Entry(_rolling_rows, _digits("rolling_sum rolling_avg")),
    "rolling_rows_global": Entry(_rolling_rows_global, _digits("rolling_sum")),
    "diff_prev_nonnull": Entry(_diff_prev_nonnull, _digits("reserves reserve_diff")),
    "running_positive": Entry(_holdings, _digits("liquidity_adj")),
    "expand_days": Entry(_expand_days),
    "topk": Entry(_topk, _digits("borrowed")),
    "topk_per_group": Entry(_topk_per_group, _digits("supplied_base_asset supplied_base_asset_usd")),
    "topk_any": Entry(_topk_any, _digits("borrow_usd repay_usd")),
    "boundary_rows": Entry(
        _boundary_rows,
        _digits("liquidity_adjusted open_liquidity close_liquidity", "price_lower_1_0 price_upper_1_0"),
    ),
    "position_day_totals": Entry(
        _position_day_totals,
        _digits("open_liquidity close_liquidity avg_liquidity", "price_lower_1_0 price_upper_1_0"),
    ),
    "price_boundaries": Entry(_price_boundaries, _digits("", "open_price close_price")),
    "last_in_bucket": Entry(_last_in_bucket, _digits("price_1_0 token0_balance_usd")),
    "last_in_bucket_running": Entry(
        lambda t: _last_in_bucket(t, F.minute("block_timestamp")), _digits("price_1_0 token0_balance_usd")
    ),
    "running_last": Entry(_running_last, _digits("token0_balance_usd")),
    "outer_day_spine": Entry(_outer_day_spine),
    "fee_growth": Entry(lambda t: pool.fee_growth(t("pool_stats")), _digits("", "fee_growth")),
    "first_seen": Entry(_first_seen, _digits("liquidity_adjusted")),
    "coef_var": Entry(lambda t: _stats(t, vari_coef=coef_var("token_price")), _digits("", "vari_coef")),
    "safe_corr": Entry(
        lambda t: _stats(
            t,
            corr_apys=safe_corr("supply_apy", "borrow_apy"),
            corr_reserves=safe_corr("reserves_token_amount", "token_price"),
        ),
        _digits("", "corr_apys corr_reserves"),
    ),
    "share_of_total": Entry(_share_of_total, _digits("liquidity", "share")),
    "pairing_type": Entry(_pairing_type),
    "pool_tvl": Entry(
        lambda t: pool.pool_tvl(t("pool_stats"), EVENTS_DAY),
        _digits("tvl virtual_liquidity_adjusted virtual_reserves_adjusted"),
    ),
    "price_range": Entry(
        lambda t: pool.price_range(t("pool_stats")),
        _digits("max_price_ever min_price_ever price_diff"),
    ),
    "action_counts": Entry(lambda t: pool.action_counts(t("lp_actions"))),
    "in_range_state": Entry(_in_range_state),
    "range_response": Entry(
        _response,
        _digits(
            "open_liquidity close_liquidity",
            "avg_price_lower_1_0 avg_price_upper_1_0 open_price close_price",
        ),
    ),
    "range_shares": Entry(
        lambda t: pool.range_shares(_response(t)),
        _digits(
            "liquidity_in_range liquidity_out_of_range",
            "pct_liquidity_in_range pct_liquidity_out_of_range pct_lps_in_range pct_lps_out_of_range",
        ),
    ),
    "recency_bucket": Entry(_recency, _digits("loan_amount_usd")),
    "movement_class": Entry(
        lambda t: pool.movement_class(_response(t)),
        _digits("open_liquidity close_liquidity", "open_price close_price"),
    ),
    "class_share": Entry(
        lambda t: pool.class_share(pool.movement_class(_response(t))),
        _digits(
            "pool_min_liquidity_adjusted",
            "pct_num_active_lps pct_min_liquidity_adjusted pct_max_liquidity_adjusted st_price_1_0 end_price_1_0",
        ),
    ),
    "tvl_share": Entry(
        _tvl_share,
        _digits(
            "open_liquidity close_liquidity open_tvl_usd close_tvl_usd",
            "price_lower_1_0 price_upper_1_0 avg_price_rng open_price close_price",
        ),
    ),
    "liquidity_at_bounds": Entry(_bounds, _digits("bound_liquidity liquidity_below total_liquidity", "price_bound_1_0")),
    "central_band": Entry(
        lambda t: bnd.central_band(_bounds(t), ["blk_date", "pool_name"]),
        _digits("", "price_bound_1_0_min price_bound_1_0_max price_bound_0_1_min price_bound_0_1_max"),
    ),
    "tvl_with_price_fallback": Entry(_hourly_tvl, _digits("token_bal_usd tvl_usd")),
    "value_per_liquidity": Entry(
        _value_per_liquidity,
        _digits("tvl_usd token_bal_usd", "tvl_usd_per_liquidity token_bal_usd_per_liquidity"),
    ),
    "cohort_label": Entry(_cohort_label, _digits("token_bal_usd avg_bal_by_lp")),
    "fee_tally": Entry(_fee_tally, _digits("token_amount_earned")),
    "off_peg": Entry(
        lambda t: flows.off_peg(t("market_stats"), ("click", "view", "purchase")),
        _digits("", "token_price avg_token_price"),
    ),
}

# --- the reports ------------------------------------------------------------------


def _pool_inputs(t: TableReader) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t("positions"), t("pool_stats"), t("lp_actions")


REPORTS: dict[str, Entry] = {
    "top_pools_by_class": Entry(
        lambda t: plans.top_pools_by_class(t("pool_stats"), EVENTS_DAY), _digits("avg_tvl")
    ),
    "borrow_deposit_ratios": Entry(
        lambda t: plans.borrow_deposit_ratios(t("borrows"), t("deposits"), ORDERS_DAY),
        _digits(
            "borrows_usd_30day_rolling_sum deposits_usd_30day_rolling_sum neg_borrows_usd_30day_rolling_sum "
            "avg_deposit_size_usd_30day_rolling avg_borrow_size_usd_30day_rolling",
            "num_borrowers_30day_rolling_avg num_depositors_30day_rolling_avg "
            "neg_num_borrowers_30day_rolling_avg borrowing_as_pct_of_deposits_usd_30day_rolling "
            "dist_num_of_borrows_as_pct_of_deposits_30day_rolling "
            "avg_num_borrowers_as_pct_of_depositors_30day_rolling",
        ),
    ),
    "off_peg_hours": Entry(
        lambda t: plans.off_peg_hours(t("market_stats"), ("click", "view", "purchase"), 0.995, 1.005),
        _digits("", "token_price avg_token_price"),
    ),
    "market_leaders": Entry(
        lambda t: plans.market_leaders(t("borrows"), t("deposits"), ORDERS_DAY),
        _digits("borrow_amt_token borrow_amt_usd deposit_amt_token deposit_amt_usd"),
    ),
    "whale_interactions": Entry(
        lambda t: plans.whale_interactions(
            t("borrows"), t("deposits"), t("repayments"), t("liquidations"), t("redemptions"), ORDERS_DAY
        ),
        _digits(
            "borrow_amt_token borrow_amt_usd deposit_amt_token deposit_amt_usd token_repay_amount "
            "loan_repay_amount_usd token_liquidation_amount loan_liquidation_amount_usd token_redeem_amount "
            "loan_redeem_amount_usd net_borrowing net_deposits borrow_total_amt_usd deposit_total_amt_usd"
        ),
    ),
    "volatility_and_apy": Entry(
        lambda t: plans.volatility_and_apy(
            t("market_stats"), "2024-01-05", "error", "2024-01-19 15:00:00", "csignup2"
        ),
        _digits(
            "",
            "avg_supply_apy std_dev_supply_apy avg_comp_apy_supply corr_supply_and_borrow_apys "
            "corr_price_and_borrow_apy net_supply_apy avg_token_price std_dev_token_price "
            "vari_coef_token_price avg_ctoken_price std_dev_ctoken_price vari_coef_ctoken_price "
            "avg_borrow_apy std_dev_borrow_apy vari_coef_avg_borrow_apy avg_comp_apy_borrow "
            "std_dev_comp_apy_borrow net_borrow_apy",
        ),
    ),
    "reserve_revenue": Entry(
        lambda t: plans.reserve_revenue(t("market_stats"), EVENTS_DAY, "20 days", "10 days"),
        _digits("revenue_usd_30day_rolling_sum"),
    ),
    "reserve_revenue_by_market": Entry(
        lambda t: plans.reserve_revenue(
            t("market_stats"), EVENTS_DAY, "20 days", "10 days", 5, partition_by_market=True
        ),
        _digits("revenue_usd_30day_rolling_sum"),
    ),
    "fees_by_provider": Entry(
        lambda t: plans.fees_by_provider(t("position_collected_fees"), CUTOFF, MANAGER),
        _digits("fees_collected_usd"),
    ),
    "fees_by_provider_corrected": Entry(
        lambda t: plans.fees_by_provider(
            t("position_collected_fees"), CUTOFF, MANAGER, token1_amount="amount1_usd", dedupe=False
        ),
        _digits("fees_collected_usd"),
    ),
    "new_providers": Entry(
        lambda t: plans.new_providers(t("positions"), t("pools")), _digits("sum_liquidity_adjusted")
    ),
    "range_response_shares": Entry(
        lambda t: plans.range_response_shares(*_pool_inputs(t), EVENTS_DAY),
        _digits(
            "",
            "pct_num_active_lps_avg pct_min_liquidity_adjusted_avg pct_max_liquidity_adjusted_avg "
            "st_price_1_0_avg end_price_1_0_avg",
        ),
    ),
    "range_response_by_class": Entry(
        lambda t: plans.range_response_by_class(*_pool_inputs(t), EVENTS_DAY, CLASS_LABELS[1]),
        _digits("", "pct_num_active_lps_avg pct_min_liquidity_adjusted_avg"),
    ),
    "largest_providers": Entry(
        lambda t: plans.largest_providers(*_pool_inputs(t), EVENTS_DAY),
        _digits("curr_tvl_usd", "avg_price_rng tvl_weighted_avg_price_rng"),
    ),
    "central_band_by_pool": Entry(
        lambda t: plans.central_band_by_pool(t("positions"), t("pool_stats"), EVENTS_DAY),
        _digits("", "price_bound_1_0_min price_bound_1_0_max price_bound_0_1_min price_bound_0_1_max"),
    ),
    "cohort_balances": Entry(
        lambda t: plans.cohort_balances(
            t("lp_actions"), t("pool_stats"), t("token_prices_hourly"), t("pools"),
            EVENTS_DAY, EVENTS_START, CUTOFF, COHORT_DAY,
        ),
        _digits("token_bal_usd avg_bal_by_lp"),
    ),
}

# The reports with the corrections that their keyword arguments offer.
_SINGLE = {"edge_prices": "edge_prices_single"}
CORRECTED: dict[str, Entry] = {
    "range_response_shares_single_price": Entry(
        lambda t: plans.range_response_shares(*_pool_inputs(t), EVENTS_DAY, single_price_row=True),
        REPORTS["range_response_shares"].digits, "range_response_shares", _SINGLE,
    ),
    "central_band_by_pool_single_price": Entry(
        lambda t: plans.central_band_by_pool(t("positions"), t("pool_stats"), EVENTS_DAY, single_price_row=True),
        REPORTS["central_band_by_pool"].digits, "central_band_by_pool", _SINGLE,
    ),
    "largest_providers_true_weighted": Entry(
        lambda t: plans.largest_providers(*_pool_inputs(t), EVENTS_DAY, true_weighted=True),
        REPORTS["largest_providers"].digits,
    ),
}

ENTRIES: dict[str, Entry] = {**REPORTS, **CORRECTED, **OPERATORS}
