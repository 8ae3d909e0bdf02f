"""The input tables, derived from the generic test data.

Each SELECT runs unchanged in Spark SQL and in the SQL engine of the oracle,
so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

ADAPTERS: dict[str, str] = {
    "borrows": """
SELECT o_orderdate AS block_timestamp, CAST(o_custkey AS STRING) AS borrower, o_orderpriority AS borrows_contract_symbol,
       o_totalprice / 100 AS loan_amount, o_totalprice AS loan_amount_usd, o_orderkey AS tx_id
FROM orders""",
    "deposits": f"""
SELECT l_shipdate AS block_timestamp, CAST(o_custkey AS STRING) AS supplier, o_orderpriority AS supplied_symbol,
       l_quantity AS supplied_base_asset, l_extendedprice AS supplied_base_asset_usd, l_orderkey AS tx_id
{_LINES}""",
    "repayments": f"""
SELECT l_shipdate AS block_timestamp, CAST(o_custkey AS STRING) AS borrower, o_orderpriority AS repay_contract_symbol,
       l_quantity AS repayed_amount, l_extendedprice AS repayed_amount_usd, l_orderkey AS tx_id
{_LINES} WHERE l_returnflag = 'R'""",
    "liquidations": f"""
SELECT l_shipdate AS block_timestamp, CAST(o_custkey AS STRING) AS borrower, o_orderpriority AS liquidation_contract_symbol,
       l_quantity AS liquidation_amount, l_extendedprice AS liquidation_amount_usd, l_orderkey AS tx_id
{_LINES} WHERE l_returnflag = 'A'""",
    "redemptions": f"""
SELECT l_shipdate AS block_timestamp, CAST(o_custkey AS STRING) AS supplier, o_orderpriority AS recieved_contract_symbol,
       l_quantity AS recieved_amount, l_extendedprice AS recieved_amount_usd, l_orderkey AS tx_id
{_LINES} WHERE l_returnflag = 'N'""",
    "market_stats": """
SELECT date_trunc('hour', ts) AS block_hour, event_type AS underlying_symbol, event_type AS ctoken_address,
       CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'csignup2'
            ELSE concat('c', event_type) END AS contract_name,
       CAST(1 + (event_id % 41 - 20) / 500e0 AS DOUBLE) AS token_price, value / 50 AS ctoken_price,
       value AS borrow_apy, value * (1 + user_id % 7) / 14 AS supply_apy,
       CAST(user_id % 5 AS DOUBLE) AS comp_apy_supply, CAST(user_id % 3 AS DOUBLE) AS comp_apy_borrow,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE value * 10 END AS reserves_token_amount,
       value / 100 AS comp_speed, value / 4 AS comp_speed_usd
FROM events""",
    "pool_stats": """
SELECT event_id AS block_id, ts AS block_timestamp, CAST(user_id % 12 AS STRING) AS pool_address,
       concat('pool-', CAST(user_id % 12 AS STRING)) AS pool_name,
       concat('t', CAST(user_id % 12 AS STRING)) AS token0_address,
       concat('t', CAST((user_id + 5) % 12 AS STRING)) AS token1_address,
       CASE WHEN user_id % 12 < 4 THEN 'USDC' WHEN user_id % 12 < 8 THEN 'WETH'
            WHEN user_id % 12 = 11 THEN NULL ELSE 'UNI' END AS token0_symbol,
       CASE WHEN user_id % 12 IN (0, 1, 4, 5) THEN 'DAI' WHEN user_id % 12 IN (2, 10) THEN NULL
            ELSE 'WBTC' END AS token1_symbol,
       1 + value AS price_1_0, value * 3 AS token0_balance_adjusted, value * 2 AS token1_balance_adjusted,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE value * 100 END AS token0_balance_usd,
       value * 50 AS token1_balance_usd, value * 7 AS virtual_liquidity_adjusted,
       10 + value AS virtual_reserves_token0_adjusted,
       CAST(5 + user_id % 7 AS DOUBLE) AS virtual_reserves_token1_adjusted,
       concat(CASE WHEN dayofyear(ts) < 15 THEN repeat('f', 24) ELSE repeat('0', 24) END,
              lpad(lower(hex(CAST((dayofyear(ts) - 15) * 24 + hour(ts) + CASE WHEN dayofyear(ts) < 15 THEN 4294967296 ELSE 0 END AS BIGINT))), 8, '0'),
              lpad(lower(hex(CAST(minute(ts) * 60 + second(ts) AS BIGINT) * 1193046)), 8, '0'),
              lpad(lower(hex(event_id * 40503 % 4294967296)), 8, '0'), repeat('a', 16)) AS fee_growth_global0_x128
FROM events""",
    "positions": """
SELECT event_id AS block_id, ts AS block_timestamp, CAST(user_id % 12 AS STRING) AS pool_address,
       concat('pool-', CAST(user_id % 12 AS STRING)) AS pool_name, CAST(user_id AS STRING) AS liquidity_provider,
       user_id * 2 + event_id % 2 AS nf_token_id,
       CASE WHEN event_type = 'error' THEN 0e0 ELSE value END AS liquidity_adjusted,
       (1 + value) / 4 AS price_lower_1_0, (1 + value) * 2 AS price_upper_1_0,
       event_type <> 'signup' AS is_active
FROM events""",
    "lp_actions": """
SELECT event_id AS tx_id, ts AS block_timestamp, CAST(user_id % 12 AS STRING) AS pool_address,
       concat('pool-', CAST(user_id % 12 AS STRING)) AS pool_name, CAST(user_id AS STRING) AS liquidity_provider,
       user_id * 2 + event_id % 2 AS nf_token_id,
       CASE WHEN event_type IN ('purchase', 'view') THEN 'INCREASE_LIQUIDITY'
            ELSE 'DECREASE_LIQUIDITY' END AS action,
       value AS liquidity_adjusted, value * 2 AS amount0_usd, value * 3 AS amount1_usd
FROM events WHERE event_type IN ('purchase', 'view', 'error')""",
    "pools": """
SELECT DISTINCT CAST(user_id % 12 AS STRING) AS pool_address FROM events WHERE user_id % 12 < 10""",
    "position_collected_fees": """
SELECT ts AS block_timestamp, CAST(user_id AS STRING) AS liquidity_provider,
       concat('T', CAST(user_id % 4 AS STRING)) AS token0_symbol,
       concat('T', CAST(event_id % 4 AS STRING)) AS token1_symbol,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS amount0_usd,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 2 END AS amount1_usd
FROM events WHERE event_type = 'click'""",
    "token_prices_hourly": """
SELECT date_trunc('hour', ts) AS hour, concat('t', CAST(user_id % 12 AS STRING)) AS token_address,
       max(value) AS price
FROM events WHERE user_id % 12 <> 3 GROUP BY 1, 2""",
}

# Declared schemas: the reader then skips the footer pass that infers them.
_BASE = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def derived_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the twelve input tables, derived from the test data in ``sf_dir``."""
    text = ADAPTERS[name]
    used = {}
    for base, schema in _BASE.items():
        if re.search(rf"\b{base}\b", text):
            used[base] = spark.read.schema(schema).parquet(f"{sf_dir}/{base}.parquet")
            text = re.sub(rf"\b{base}\b", "{" + base + "}", text)
    df = spark.sql(text, **used)
    # date_trunc yields a zoned timestamp even for a zone-less input.
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp_ntz"))
    return df
