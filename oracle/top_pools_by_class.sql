SELECT blk_date AS block_day, pool_name,
       CASE pairing_type WHEN '_stable_stable_' THEN '_Stable_Stable_' WHEN '_stable_other_' THEN '_Stable_Unstable_'
            ELSE '_Unstable_Unstable_' END AS pairing_type,
       tvl AS avg_tvl, row_number() OVER (PARTITION BY pairing_type ORDER BY tvl DESC, pool_name) AS rank
FROM pool_value
QUALIFY rank <= 5
