WITH owned AS (
  SELECT CAST(block_timestamp AS DATE) AS block_day, liquidity_provider AS lp, sum(amount0_usd) AS usd
  FROM lp_actions GROUP BY 1, 2),
a AS (SELECT lp FROM owned WHERE block_day = DATE '2024-01-10' ORDER BY usd DESC, lp LIMIT 30),
b AS (SELECT lp FROM owned WHERE block_day = DATE '2024-01-30' ORDER BY usd DESC, lp LIMIT 30),
named AS (SELECT *, lp IN (FROM a) AS in_a, lp IN (FROM b) AS in_b FROM owned)
SELECT block_day,
       CASE WHEN in_a AND in_b THEN 'Always_Top_30' WHEN in_a THEN 'Top_30_May10_Only'
            WHEN in_b THEN 'Top_30_Today_Only' ELSE 'Not_Top_30' END AS liquidity_provider_grp,
       if(in_a AND in_b, CAST(lp AS VARCHAR), '_not_') AS top_6_address,
       sum(usd) AS token_bal_usd, count(DISTINCT lp) AS num_providers, sum(usd) / count(DISTINCT lp) AS avg_bal_by_lp
FROM named GROUP BY 1, 2, 3
