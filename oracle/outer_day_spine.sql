WITH firsts AS (
  SELECT liquidity_provider, pool_address, pool_name, min(CAST(block_timestamp AS DATE)) AS min_date FROM lp_actions GROUP BY ALL
), days AS (
  SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day
)
SELECT day, liquidity_provider, pool_address, pool_name, min_date FROM days JOIN firsts ON day >= min_date
UNION ALL
SELECT day, NULL, NULL, NULL, NULL FROM days WHERE day < (SELECT min(min_date) FROM firsts)
UNION ALL
SELECT NULL, liquidity_provider, pool_address, pool_name, min_date FROM firsts WHERE min_date > DATE '2024-01-20'
