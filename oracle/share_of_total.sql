WITH held AS (SELECT pool_name, liquidity_provider, sum(liquidity_adjusted) AS liquidity FROM positions GROUP BY 1, 2),
pooled AS (SELECT pool_name, sum(liquidity) AS total FROM held GROUP BY 1)
SELECT h.pool_name, h.liquidity_provider, h.liquidity, h.liquidity / nullif(p.total, 0) AS share
FROM held h JOIN pooled p ON h.pool_name = p.pool_name
