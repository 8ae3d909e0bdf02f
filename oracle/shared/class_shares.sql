WITH folded AS (
  SELECT blk_date, pool_name, change_that_day, grouping(change_that_day) AS whole,
         count(DISTINCT liquidity_provider) AS n, sum(open_liquidity) AS opened, sum(close_liquidity) AS closed,
         avg(open_price) AS st_price_1_0, avg(close_price) AS end_price_1_0
  FROM movements WHERE open_state = '_out_of_range_'
  GROUP BY GROUPING SETS ((blk_date, pool_name, change_that_day), (blk_date, pool_name))),
beside AS (
  SELECT *, max(n) FILTER (whole = 1) OVER pool AS all_n, max(opened) FILTER (whole = 1) OVER pool AS all_opened,
         max(closed) FILTER (whole = 1) OVER pool AS all_closed
  FROM folded WINDOW pool AS (PARTITION BY blk_date, pool_name))
SELECT blk_date, pool_name, change_that_day, n / nullif(all_n, 0) AS pct_num_active_lps,
       opened / nullif(all_opened, 0) AS pct_min_liquidity_adjusted,
       closed / nullif(all_closed, 0) AS pct_max_liquidity_adjusted, st_price_1_0, end_price_1_0,
       all_n AS pool_num_active_lps, all_opened AS pool_min_liquidity_adjusted
FROM beside WHERE whole = 0
