SELECT *, liquidity_in_range / nullif(liquidity_in_range + liquidity_out_of_range, 0) AS pct_liquidity_in_range,
       liquidity_out_of_range / nullif(liquidity_in_range + liquidity_out_of_range, 0) AS pct_liquidity_out_of_range,
       num_lps_in_range / nullif(num_lps, 0) AS pct_lps_in_range, num_lps_out_of_range / nullif(num_lps, 0) AS pct_lps_out_of_range
FROM (SELECT blk_date, pool_name,
             sum(close_liquidity * (close_state = '_in_range_')::INT) AS liquidity_in_range,
             sum(close_liquidity * (close_state <> '_in_range_')::INT) AS liquidity_out_of_range,
             count(DISTINCT liquidity_provider) FILTER (WHERE close_state = '_in_range_') AS num_lps_in_range,
             count(DISTINCT liquidity_provider) FILTER (WHERE close_state <> '_in_range_') AS num_lps_out_of_range,
             count(DISTINCT liquidity_provider) AS num_lps
      FROM responses GROUP BY ALL)
