SELECT block_day, underlying_symbol,
       sum(price) OVER (ORDER BY block_day, underlying_symbol ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_sum
FROM (SELECT underlying_symbol, CAST(block_hour AS DATE) AS block_day, avg(ctoken_price) AS price
      FROM market_stats GROUP BY 1, 2)
