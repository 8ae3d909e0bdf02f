WITH summed AS (
  SELECT *, sum(liq) OVER (PARTITION BY blk_date, pool_name ORDER BY edge) AS below,
         sum(liq) OVER (PARTITION BY blk_date, pool_name ORDER BY edge DESC) AS above,
         sum(liq) OVER (PARTITION BY blk_date, pool_name) AS total
  FROM covered)
SELECT blk_date, pool_name, min(edge) AS price_bound_1_0_min, max(edge) AS price_bound_1_0_max,
       1 / min(edge) AS price_bound_0_1_min, 1 / max(edge) AS price_bound_0_1_max
FROM summed WHERE below / nullif(total, 0) >= 0.1 AND above / nullif(total, 0) >= 0.1
GROUP BY 1, 2
