WITH worth AS (
  SELECT pool_name, liquidity_provider, price_lower_1_0, price_upper_1_0, pairing_type, close_state, open_state,
         avg(width) AS width, sum(open_usd) AS usd
  FROM valued_bands WHERE blk_date = DATE '2024-01-30' GROUP BY 1, 2, 3, 4, 5, 6, 7)
SELECT liquidity_provider, avg(width) AS avg_price_rng, avg(width * usd) / nullif(sum(usd), 0) AS tvl_weighted_avg_price_rng,
       sum(usd) AS curr_tvl_usd, row_number() OVER (ORDER BY sum(usd) DESC, liquidity_provider) AS rank
FROM worth WHERE usd > 0 GROUP BY 1 QUALIFY rank <= 3
