SELECT pool_address, liquidity_provider, nf_token_id, blk_date, pool_name, price_lower_1_0, price_upper_1_0,
       sum(if(opens, liquidity_adjusted, 0)) AS open_liquidity,
       sum(if(closes, liquidity_adjusted, 0)) AS close_liquidity,
       avg(liquidity_adjusted) AS avg_liquidity
FROM edge_flags WHERE liquidity_adjusted > 0 GROUP BY ALL
