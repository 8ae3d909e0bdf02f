SELECT liquidity_provider, pool_address, pool_name, day
FROM (SELECT liquidity_provider, pool_address, pool_name, min(CAST(block_timestamp AS DATE)) AS first_day
      FROM lp_actions GROUP BY ALL) x
JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-03', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day) d
  ON d.day >= x.first_day
