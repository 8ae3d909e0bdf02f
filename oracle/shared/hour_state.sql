SELECT s.block_hour, s.pool_address, s.pool_name,
       s.virtual_reserves_token0_adjusted AS v0, s.virtual_reserves_token1_adjusted AS v1, a.price AS p0, b.price AS p1,
       s.token0_balance_adjusted AS g0, s.token1_balance_adjusted AS g1,
       s.token0_balance_usd AS usd0, s.token1_balance_usd AS usd1
FROM (SELECT *, date_trunc('hour', block_timestamp) AS block_hour FROM pool_stats
      QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', block_timestamp), pool_address, pool_name
                                 ORDER BY block_timestamp DESC, block_id DESC) = 1) s
LEFT JOIN token_prices_hourly a ON a.hour = s.block_hour AND a.token_address = s.token0_address
LEFT JOIN token_prices_hourly b ON b.hour = s.block_hour AND b.token_address = s.token1_address
