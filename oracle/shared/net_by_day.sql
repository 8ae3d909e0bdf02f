SELECT coalesce(i.day, o.day) AS day, coalesce(i.liquidity_provider, o.liquidity_provider) AS liquidity_provider,
       coalesce(i.pool_address, o.pool_address) AS pool_address, coalesce(i.pool_name, o.pool_name) AS pool_name,
       coalesce(i.liq, 0) - coalesce(o.liq, 0) AS net_liquidity
FROM (SELECT CAST(block_timestamp AS DATE) AS day, liquidity_provider, pool_address, pool_name,
             sum(CAST(liquidity_adjusted AS DECIMAL(38, 8))) AS liq, sum(amount0_usd + amount1_usd) AS usd
      FROM lp_actions WHERE action = 'INCREASE_LIQUIDITY' GROUP BY ALL) i
FULL JOIN (SELECT CAST(block_timestamp AS DATE) AS day, liquidity_provider, pool_address, pool_name,
                  sum(CAST(liquidity_adjusted AS DECIMAL(38, 8))) AS liq, sum(amount0_usd + amount1_usd) AS usd
           FROM lp_actions WHERE action = 'DECREASE_LIQUIDITY' GROUP BY ALL) o
  ON i.day = o.day AND i.liquidity_provider = o.liquidity_provider
 AND i.pool_address = o.pool_address AND i.pool_name = o.pool_name
WHERE i.usd IS NOT NULL OR o.usd IS NOT NULL
