WITH best AS (
  SELECT pool_address, blk_date FROM pool_value
  QUALIFY row_number() OVER (PARTITION BY pairing_type ORDER BY tvl DESC, pool_address) <= 5),
bands AS (
  SELECT b.pool_name, b.blk_date, b.liquidity_provider, b.price_lower_1_0 AS lo, b.price_upper_1_0 AS hi,
         sum(b.avg_liquidity) AS liq
  FROM day_bands b JOIN best USING (pool_address)
  LEFT JOIN edge_prices p ON p.pool_address = b.pool_address AND p.blk_date = b.blk_date
  WHERE b.blk_date = DATE '2024-01-30' GROUP BY 1, 2, 3, 4, 5),
spanned AS (
  SELECT x.blk_date, x.pool_name, x.edge, sum(if(x.edge BETWEEN b.lo AND b.hi, b.liq, 0)) AS liq
  FROM (SELECT blk_date, pool_name, lo AS edge FROM bands UNION SELECT blk_date, pool_name, hi FROM bands) x
  JOIN bands b USING (blk_date, pool_name)
  GROUP BY 1, 2, 3),
summed AS (
  SELECT *, sum(liq) OVER (PARTITION BY blk_date, pool_name ORDER BY edge) AS below,
         sum(liq) OVER (PARTITION BY blk_date, pool_name ORDER BY edge DESC) AS above,
         sum(liq) OVER (PARTITION BY blk_date, pool_name) AS total
  FROM spanned)
SELECT blk_date, pool_name, min(edge) AS price_bound_1_0_min, max(edge) AS price_bound_1_0_max,
       1 / min(edge) AS price_bound_0_1_min, 1 / max(edge) AS price_bound_0_1_max
FROM summed WHERE below / nullif(total, 0) >= 0.1 AND above / nullif(total, 0) >= 0.1
GROUP BY 1, 2
