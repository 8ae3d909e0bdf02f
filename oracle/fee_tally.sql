SELECT liquidity_provider, token0_symbol AS token, CAST(sum(CAST(coalesce(amount0_usd, 0) AS DECIMAL(38, 8))) AS DOUBLE) AS token_amount_earned
FROM position_collected_fees WHERE block_timestamp > TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1, 2
UNION
SELECT liquidity_provider, token1_symbol, CAST(sum(CAST(coalesce(amount0_usd, 0) AS DECIMAL(38, 8))) AS DOUBLE)
FROM position_collected_fees WHERE block_timestamp > TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1, 2
