SELECT blk_date, change_that_day, avg(pct_num_active_lps) AS pct_num_active_lps_avg,
       avg(pct_min_liquidity_adjusted) AS pct_min_liquidity_adjusted_avg,
       avg(pct_max_liquidity_adjusted) AS pct_max_liquidity_adjusted_avg,
       avg(st_price_1_0) AS st_price_1_0_avg, avg(end_price_1_0) AS end_price_1_0_avg
FROM class_shares
WHERE pool_name IN (SELECT pool_name FROM pool_value ORDER BY tvl DESC, pool_address LIMIT 5)
GROUP BY 1, 2
