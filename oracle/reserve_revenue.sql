WITH a AS (
  SELECT underlying_symbol, CAST(block_hour AS DATE) AS date, ctoken_address, avg(token_price) AS price,
         avg(reserves_token_amount) AS held
  FROM market_stats
  WHERE block_hour > TIMESTAMP '2024-01-30' - INTERVAL 20 DAY AND block_hour < DATE '2024-01-31' GROUP BY 1, 2, 3),
c AS (
  SELECT date, ctoken_address,
         (held - lag(held, 1 IGNORE NULLS) OVER (PARTITION BY ctoken_address ORDER BY date)) * price AS gain
  FROM a)
SELECT a.date, a.underlying_symbol,
       sum(c.gain) OVER (ORDER BY a.date, a.ctoken_address ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
         AS revenue_usd_30day_rolling_sum
FROM a JOIN c ON a.date = c.date AND a.ctoken_address = c.ctoken_address
WHERE a.date > TIMESTAMP '2024-01-30' - INTERVAL 10 DAY
