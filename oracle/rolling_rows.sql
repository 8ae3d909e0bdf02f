SELECT underlying_symbol, block_day, sum(price) OVER w AS rolling_sum, avg(price) OVER w AS rolling_avg
FROM (SELECT underlying_symbol, CAST(block_hour AS DATE) AS block_day, avg(ctoken_price) AS price
      FROM market_stats GROUP BY 1, 2)
WINDOW w AS (PARTITION BY underlying_symbol ORDER BY block_day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
