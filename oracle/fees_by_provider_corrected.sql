SELECT liquidity_provider, token, sum(earned) AS fees_collected_usd
FROM (SELECT liquidity_provider, token0_symbol AS token, coalesce(amount0_usd, 0) AS earned, block_timestamp
      FROM position_collected_fees
      UNION ALL
      SELECT liquidity_provider, token1_symbol, coalesce(amount1_usd, 0), block_timestamp
      FROM position_collected_fees)
WHERE liquidity_provider <> '7' AND block_timestamp > TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1, 2
