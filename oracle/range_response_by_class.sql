WITH means AS (
  SELECT blk_date, change_that_day, avg(pct_num_active_lps) AS n, avg(pct_min_liquidity_adjusted) AS o
  FROM class_shares
  WHERE pool_num_active_lps > 0 AND pool_min_liquidity_adjusted > 0
    AND pool_name IN (SELECT pool_name FROM pool_value WHERE pairing_type = '_stable_other_'
                      ORDER BY tvl DESC, pool_address LIMIT 5)
  GROUP BY 1, 2),
days AS (SELECT blk_date, sum(n) AS n, sum(o) AS o FROM means GROUP BY 1)
SELECT m.blk_date, m.change_that_day, m.n / nullif(d.n, 0) AS pct_num_active_lps_avg,
       m.o / nullif(d.o, 0) AS pct_min_liquidity_adjusted_avg
FROM means m LEFT JOIN days d ON m.blk_date = d.blk_date
