SELECT block_id, pool_name, price_1_0 FROM pool_stats WHERE CAST(block_timestamp AS DATE) = DATE '2024-01-30'
