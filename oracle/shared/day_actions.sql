SELECT pool_address, CAST(block_timestamp AS DATE) AS blk_date, liquidity_provider, nf_token_id,
       count(*) FILTER (action = 'INCREASE_LIQUIDITY') AS token_increases,
       count(*) FILTER (action = 'DECREASE_LIQUIDITY') AS token_decreases
FROM lp_actions GROUP BY ALL
