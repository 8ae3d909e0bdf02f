SELECT b.pool_name, b.blk_date, b.liquidity_provider,
       if(coalesce(p.close_price BETWEEN b.price_lower_1_0 AND b.price_upper_1_0, false),
          '_in_range_', '_out_of_range_') AS close_state,
       if(coalesce(p.open_price BETWEEN b.price_lower_1_0 AND b.price_upper_1_0, false),
          '_in_range_', '_out_of_range_') AS open_state,
       avg(b.price_lower_1_0) AS avg_price_lower_1_0, avg(b.price_upper_1_0) AS avg_price_upper_1_0,
       avg(p.close_price) AS close_price, avg(p.open_price) AS open_price,
       sum(b.close_liquidity) AS close_liquidity, sum(b.open_liquidity) AS open_liquidity,
       CAST(sum(coalesce(a.token_increases, 0)) AS BIGINT) AS token_increases,
       CAST(sum(coalesce(a.token_decreases, 0)) AS BIGINT) AS token_decreases
FROM edge_bands b
LEFT JOIN edge_prices p USING (pool_address, blk_date)
LEFT JOIN day_actions a USING (pool_address, blk_date, liquidity_provider, nf_token_id)
GROUP BY 1, 2, 3, 4, 5
