SELECT pool_address, liquidity_provider, nf_token_id, blk_date, block_id, pool_name, price_lower_1_0, price_upper_1_0,
       liquidity_adjusted, open_liquidity, close_liquidity
FROM edge_bands
