WITH day AS (
  SELECT CAST(block_hour AS DATE) AS block_day, underlying_symbol,
         avg(supply_apy) AS s, stddev_samp(supply_apy) AS ss, avg(comp_apy_supply) AS cs,
         avg(token_price) AS t, stddev_samp(token_price) AS st, avg(ctoken_price) AS c, stddev_samp(ctoken_price) AS sc,
         avg(borrow_apy) AS b, stddev_samp(borrow_apy) AS sb, avg(comp_apy_borrow) AS cb,
         stddev_samp(comp_apy_borrow) AS scb,
         covar_pop(supply_apy, borrow_apy) / nullif(stddev_pop(supply_apy) * stddev_pop(borrow_apy), 0) AS r1,
         covar_pop(token_price, borrow_apy) / nullif(stddev_pop(token_price) * stddev_pop(borrow_apy), 0) AS r2
  FROM market_stats
  WHERE block_hour >= DATE '2024-01-05' AND underlying_symbol <> 'error' AND contract_name <> 'csignup2'
    AND block_hour <> TIMESTAMP '2024-01-19 15:00:00'
  GROUP BY 1, 2)
SELECT block_day, underlying_symbol, s AS avg_supply_apy, ss AS std_dev_supply_apy, cs AS avg_comp_apy_supply,
       r1 AS corr_supply_and_borrow_apys, r2 AS corr_price_and_borrow_apy, s + cs AS net_supply_apy,
       t AS avg_token_price, st AS std_dev_token_price, st / nullif(t, 0) AS vari_coef_token_price,
       c AS avg_ctoken_price, sc AS std_dev_ctoken_price, sc / nullif(c, 0) AS vari_coef_ctoken_price,
       b AS avg_borrow_apy, sb AS std_dev_borrow_apy, sb / nullif(b, 0) AS vari_coef_avg_borrow_apy,
       cb AS avg_comp_apy_borrow, scb AS std_dev_comp_apy_borrow, b - cb AS net_borrow_apy
FROM day
