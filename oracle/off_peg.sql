SELECT underlying_symbol, block_hour, sum(token_price) AS token_price, avg(token_price) AS avg_token_price
FROM market_stats WHERE underlying_symbol IN ('click', 'view', 'purchase')
GROUP BY 1, 2 HAVING avg(token_price) NOT BETWEEN 0.99 AND 1.01
