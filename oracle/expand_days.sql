SELECT liquidity_provider, d.day AS block_day
FROM (SELECT liquidity_provider, CAST(min(block_timestamp) AS DATE) AS first_day, CAST(max(block_timestamp) AS DATE) AS last_day
      FROM lp_actions GROUP BY 1) s
JOIN (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day) d
  ON d.day BETWEEN s.first_day AND s.last_day
