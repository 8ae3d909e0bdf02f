SELECT liquidity_provider, pool_address, pool_name, block_day, CAST(running AS DOUBLE) AS liquidity_adj
FROM (SELECT e.liquidity_provider, e.pool_address, e.pool_name, e.block_day,
             sum(coalesce(n.net_liquidity, 0)) OVER (
               PARTITION BY e.liquidity_provider, e.pool_address, e.pool_name ORDER BY e.block_day
               ROWS UNBOUNDED PRECEDING) AS running
      FROM (SELECT liquidity_provider, pool_address, pool_name, d.block_day
            FROM (SELECT liquidity_provider, pool_address, pool_name,
                         min(CAST(block_timestamp AS DATE)) AS first_day
                  FROM lp_actions GROUP BY ALL) x
            JOIN (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE)
                         AS block_day) d ON d.block_day >= x.first_day) e
      LEFT JOIN net_by_day n ON n.liquidity_provider = e.liquidity_provider AND n.pool_address = e.pool_address
        AND n.pool_name = e.pool_name AND n.day = e.block_day)
WHERE running > 0
