SELECT pool_address, blk_date, if(block_id = first_id, price_1_0, 0) AS open_price,
       if(block_id = last_id, price_1_0, 0) AS close_price
FROM (SELECT pool_address, CAST(block_timestamp AS DATE) AS blk_date, block_id, price_1_0,
             min(block_id) OVER d AS first_id, max(block_id) OVER d AS last_id
      FROM pool_stats WINDOW d AS (PARTITION BY pool_address, CAST(block_timestamp AS DATE)))
WHERE price_1_0 > 0 AND block_id IN (first_id, last_id)
