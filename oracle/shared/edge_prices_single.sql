SELECT pool_address, blk_date,
       greatest(arg_min(price_1_0, block_id), 0) AS open_price, greatest(arg_max(price_1_0, block_id), 0) AS close_price
FROM (SELECT pool_address, CAST(block_timestamp AS DATE) AS blk_date, block_id, price_1_0 FROM pool_stats)
GROUP BY 1, 2
