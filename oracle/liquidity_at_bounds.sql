SELECT blk_date, pool_name, edge AS price_bound_1_0, liq AS bound_liquidity,
       sum(liq) OVER (PARTITION BY blk_date, pool_name ORDER BY edge) AS liquidity_below,
       sum(liq) OVER (PARTITION BY blk_date, pool_name) AS total_liquidity
FROM covered
