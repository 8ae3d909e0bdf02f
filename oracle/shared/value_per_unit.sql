SELECT h.block_day, h.pool_address, h.pool_name, coalesce(v.tvl_usd, 0) AS tvl_usd,
       coalesce(v.tvl_usd, 0) / nullif(h.total, 0) AS tvl_usd_per_liquidity,
       coalesce(v.token_bal_usd, 0) AS token_bal_usd,
       coalesce(v.token_bal_usd, 0) / nullif(h.total, 0) AS token_bal_usd_per_liquidity
FROM (SELECT block_day, pool_address, pool_name, sum(liquidity_adj) AS total FROM holdings GROUP BY ALL) h
LEFT JOIN (SELECT CAST(block_hour AS DATE) AS block_day, pool_address, tvl_usd, token_bal_usd
           FROM hour_value WHERE tvl_usd IS NOT NULL AND NOT isnan(tvl_usd)
           QUALIFY row_number() OVER (PARTITION BY CAST(block_hour AS DATE), pool_address
                                      ORDER BY block_hour DESC, pool_name DESC) = 1) v
  USING (block_day, pool_address)
