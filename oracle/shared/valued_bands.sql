SELECT b.pool_name, b.blk_date, b.liquidity_provider, b.price_lower_1_0, b.price_upper_1_0, b.open_liquidity, b.close_liquidity,
       f.pairing_type, p.open_price, p.close_price, a.token_increases, a.token_decreases,
       if(coalesce(p.close_price BETWEEN b.price_lower_1_0 AND b.price_upper_1_0, false), '_in_range_', '_out_of_range_') AS close_state,
       if(coalesce(p.open_price BETWEEN b.price_lower_1_0 AND b.price_upper_1_0, false), '_in_range_', '_out_of_range_') AS open_state,
       abs(b.price_upper_1_0 - b.price_lower_1_0) / nullif(if(g.price_diff > 0, g.price_diff, NULL), 0) AS width,
       b.close_liquidity / nullif(s.all_close, 0) * f.tvl AS close_usd,
       b.open_liquidity / nullif(s.all_open, 0) * f.tvl AS open_usd
FROM edge_bands b
JOIN pool_value f USING (pool_address)
LEFT JOIN (SELECT pool_address, blk_date, sum(open_liquidity) AS all_open, sum(close_liquidity) AS all_close
           FROM edge_bands GROUP BY ALL) s ON s.pool_address = b.pool_address AND s.blk_date = f.blk_date
LEFT JOIN edge_prices p ON p.pool_address = b.pool_address AND p.blk_date = b.blk_date
LEFT JOIN day_actions a ON a.pool_address = b.pool_address AND a.blk_date = b.blk_date
      AND a.liquidity_provider = b.liquidity_provider AND a.nf_token_id = b.nf_token_id
LEFT JOIN price_span g ON g.pool_address = b.pool_address
