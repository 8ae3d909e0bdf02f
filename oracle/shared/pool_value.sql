SELECT pool_address, pool_name, token0_symbol, token1_symbol,
       CASE WHEN token0_symbol IN (SELECT symbol FROM stables) AND token1_symbol IN (SELECT symbol FROM stables) THEN '_stable_stable_'
            WHEN token0_symbol IN (SELECT symbol FROM stables) OR token1_symbol IN (SELECT symbol FROM stables) THEN '_stable_other_'
            ELSE '_other_other_' END AS pairing_type,
       CAST(block_timestamp AS DATE) AS blk_date,
       avg(token0_balance_usd + token1_balance_usd) AS tvl,
       avg(virtual_liquidity_adjusted) AS virtual_liquidity_adjusted,
       avg(virtual_reserves_token0_adjusted + virtual_reserves_token1_adjusted) AS virtual_reserves_adjusted
FROM pool_stats
WHERE CAST(block_timestamp AS DATE) = DATE '2024-01-30' AND token0_balance_usd + token1_balance_usd IS NOT NULL
GROUP BY ALL
