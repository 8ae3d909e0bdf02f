SELECT * EXCLUDE (opens, closes), if(opens, liquidity_adjusted, 0) AS open_liquidity,
       if(closes, liquidity_adjusted, 0) AS close_liquidity
FROM edge_flags WHERE liquidity_adjusted > 0 AND (opens OR closes)
