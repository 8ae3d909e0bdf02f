SELECT block_hour, pool_address, pool_name,
       if(p0 IS NULL, 'price1', if(p1 IS NULL, 'price0', 'both prices')) AS price_status,
       usd0 + usd1 AS token_bal_usd,
       CASE WHEN p0 IS NULL THEN p1 * g1 + g0 * (v1 * pow(v0, -1)) * p1
            WHEN p1 IS NULL THEN p0 * g0 + g1 * (v0 * pow(v1, -1)) * p0
            ELSE p0 * g0 + p1 * g1 END AS tvl_usd
FROM hour_state WHERE p0 IS NOT NULL OR p1 IS NOT NULL
