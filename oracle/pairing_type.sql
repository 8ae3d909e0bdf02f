SELECT block_id,
       CASE WHEN token0_symbol IN (SELECT symbol FROM stables) AND token1_symbol IN (SELECT symbol FROM stables) THEN '_stable_stable_'
            WHEN token0_symbol IN (SELECT symbol FROM stables) OR token1_symbol IN (SELECT symbol FROM stables) THEN '_stable_other_'
            ELSE '_other_other_' END AS pairing_type
FROM pool_stats
