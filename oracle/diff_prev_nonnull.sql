SELECT ctoken_address, block_hour, reserves,
       reserves - lag(reserves, 1 IGNORE NULLS) OVER (PARTITION BY ctoken_address ORDER BY block_hour) AS reserve_diff
FROM (SELECT ctoken_address, block_hour, max(reserves_token_amount) AS reserves FROM market_stats GROUP BY 1, 2)
