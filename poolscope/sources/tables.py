"""The twelve input tables: schemas and a parquet reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "ts": T.TimestampNTZType(),
    "s": T.StringType(),
    "d": T.DoubleType(),
    "l": T.LongType(),
    "b": T.BooleanType(),
}


def _schema(spec: str) -> T.StructType:
    fields = (entry.split(":") for entry in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Table and column names of the input data model.
SCHEMAS: dict[str, T.StructType] = {
    "borrows": _schema(
        "block_timestamp:ts borrower:s borrows_contract_symbol:s loan_amount:d loan_amount_usd:d tx_id:s"
    ),
    "deposits": _schema(
        "block_timestamp:ts supplier:s supplied_symbol:s supplied_base_asset:d "
        "supplied_base_asset_usd:d tx_id:s"
    ),
    "repayments": _schema(
        "block_timestamp:ts borrower:s repay_contract_symbol:s repayed_amount:d repayed_amount_usd:d tx_id:s"
    ),
    "liquidations": _schema(
        "block_timestamp:ts borrower:s liquidation_contract_symbol:s liquidation_amount:d "
        "liquidation_amount_usd:d tx_id:s"
    ),
    "redemptions": _schema(
        "block_timestamp:ts supplier:s recieved_contract_symbol:s recieved_amount:d "
        "recieved_amount_usd:d tx_id:s"
    ),
    "market_stats": _schema(
        "block_hour:ts underlying_symbol:s ctoken_address:s contract_name:s token_price:d ctoken_price:d "
        "supply_apy:d borrow_apy:d comp_apy_supply:d comp_apy_borrow:d reserves_token_amount:d "
        "comp_speed:d comp_speed_usd:d"
    ),
    "positions": _schema(
        "block_id:l block_timestamp:ts pool_address:s pool_name:s liquidity_provider:s nf_token_id:l "
        "liquidity_adjusted:d price_lower_1_0:d price_upper_1_0:d is_active:b"
    ),
    "pool_stats": _schema(
        "block_id:l block_timestamp:ts pool_address:s pool_name:s token0_address:s token1_address:s "
        "token0_symbol:s token1_symbol:s price_1_0:d token0_balance_adjusted:d token1_balance_adjusted:d "
        "token0_balance_usd:d token1_balance_usd:d virtual_liquidity_adjusted:d "
        "virtual_reserves_token0_adjusted:d virtual_reserves_token1_adjusted:d fee_growth_global0_x128:s"
    ),
    "lp_actions": _schema(
        "tx_id:s block_timestamp:ts action:s liquidity_provider:s liquidity_adjusted:d pool_address:s "
        "pool_name:s nf_token_id:l price_lower_1_0:d price_upper_1_0:d price_lower_1_0_usd:d "
        "price_upper_1_0_usd:d token0_address:s token1_address:s token0_symbol:s token1_symbol:s "
        "amount0_adjusted:d amount1_adjusted:d amount0_usd:d amount1_usd:d"
    ),
    "pools": _schema("pool_address:s"),
    "position_collected_fees": _schema(
        "block_timestamp:ts liquidity_provider:s token0_symbol:s token1_symbol:s amount0_usd:d amount1_usd:d"
    ),
    "token_prices_hourly": _schema("hour:ts token_address:s price:d"),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one input table from ``root/name`` with its declared schema.

    A declared schema skips footer inference over every file of a large table
    and makes a wrong type fail at the scan instead of deep in a report.
    """
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
