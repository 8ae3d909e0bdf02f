SELECT block_id, pool_address, last_value(token0_balance_usd IGNORE NULLS) OVER (
         PARTITION BY pool_address ORDER BY block_timestamp, block_id) AS token0_balance_usd
FROM pool_stats
