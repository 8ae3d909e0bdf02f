SELECT pool_address, max(price_1_0) AS max_price_ever, min(price_1_0) AS min_price_ever,
       abs(max(price_1_0) - min(price_1_0)) AS price_diff
FROM pool_stats GROUP BY pool_address
