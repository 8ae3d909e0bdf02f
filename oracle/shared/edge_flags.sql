SELECT pool_address, pool_name, nf_token_id, liquidity_provider, price_lower_1_0, price_upper_1_0,
       block_id, liquidity_adjusted, CAST(block_timestamp AS DATE) AS blk_date,
       block_id = min(block_id) OVER per_day AS opens, block_id = max(block_id) OVER per_day AS closes
FROM positions
WINDOW per_day AS (PARTITION BY pool_address, liquidity_provider, nf_token_id, CAST(block_timestamp AS DATE))
