SELECT DISTINCT date_trunc('hour', block_timestamp) AS block_hour, pool_address, pool_name,
       last_value(price_1_0) OVER h AS price_1_0, last_value(token0_balance_usd) OVER h AS token0_balance_usd
FROM pool_stats
WINDOW h AS (PARTITION BY date_trunc('hour', block_timestamp), pool_address, pool_name
             ORDER BY block_timestamp, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
