SELECT x.blk_date, x.pool_name, x.edge,
       sum(if(x.edge BETWEEN b.price_lower_1_0 AND b.price_upper_1_0, b.avg_liquidity, 0)) AS liq
FROM (SELECT blk_date, pool_name, price_lower_1_0 AS edge FROM day_bands
      UNION SELECT blk_date, pool_name, price_upper_1_0 FROM day_bands) x
JOIN day_bands b USING (blk_date, pool_name)
GROUP BY 1, 2, 3
