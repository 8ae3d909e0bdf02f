WITH firsts AS (SELECT liquidity_provider, min(block_timestamp) AS at FROM positions GROUP BY 1)
SELECT CAST(p.block_timestamp AS DATE) AS block_day, sum(p.liquidity_adjusted) AS sum_liquidity_adjusted,
       count(DISTINCT p.liquidity_provider) AS cnt
FROM positions p JOIN firsts f ON p.liquidity_provider = f.liquidity_provider AND p.block_timestamp = f.at
WHERE p.pool_address IN (SELECT pool_address FROM pools) AND p.is_active AND p.liquidity_adjusted > 0
GROUP BY 1
