SELECT underlying_symbol, CAST(block_hour AS DATE) AS block_day, stddev_samp(token_price) / nullif(avg(token_price), 0) AS vari_coef
FROM market_stats GROUP BY 1, 2
