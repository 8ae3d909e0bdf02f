SELECT pairing_type, pool_name, blk_date, liquidity_provider, price_lower_1_0, price_upper_1_0, close_state, open_state,
       avg(width) AS avg_price_rng, avg(close_price) AS close_price, avg(open_price) AS open_price,
       sum(close_liquidity) AS close_liquidity, sum(open_liquidity) AS open_liquidity,
       CAST(sum(coalesce(token_increases, 0)) AS BIGINT) AS token_increases,
       CAST(sum(coalesce(token_decreases, 0)) AS BIGINT) AS token_decreases,
       sum(close_usd) AS close_tvl_usd, sum(open_usd) AS open_tvl_usd
FROM valued_bands
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
