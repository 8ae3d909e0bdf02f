WITH held AS (
  SELECT * FROM holdings
  WHERE block_day > TIMESTAMP '2024-01-05 12:00:00' AND pool_address IN (SELECT pool_address FROM pools)),
owned AS (
  SELECT h.block_day, h.liquidity_provider, sum(v.token_bal_usd_per_liquidity * h.liquidity_adj) AS usd
  FROM held h JOIN value_per_unit v ON h.block_day = v.block_day AND h.pool_address = v.pool_address
  WHERE v.token_bal_usd_per_liquidity > 0 GROUP BY 1, 2),
a AS (SELECT liquidity_provider AS lp FROM owned WHERE block_day = DATE '2024-01-10'
      ORDER BY usd DESC, liquidity_provider LIMIT 30),
b AS (SELECT liquidity_provider AS lp FROM owned WHERE block_day = DATE '2024-01-30'
      ORDER BY usd DESC, liquidity_provider LIMIT 30),
named AS (
  SELECT o.block_day, o.usd, o.liquidity_provider AS lp, o.liquidity_provider IN (FROM a) AS in_a,
         o.liquidity_provider IN (FROM b) AS in_b FROM owned o)
SELECT block_day,
       CASE WHEN in_a AND in_b THEN 'Always_Top_30' WHEN in_a THEN 'Top_30_May10_Only'
            WHEN in_b THEN 'Top_30_Today_Only' ELSE 'Not_Top_30' END AS liquidity_provider_grp,
       if(in_a AND in_b, CAST(lp AS VARCHAR), '_not_') AS top_6_address,
       sum(usd) AS token_bal_usd, count(DISTINCT lp) AS num_providers, sum(usd) / count(DISTINCT lp) AS avg_bal_by_lp
FROM named GROUP BY 1, 2, 3
