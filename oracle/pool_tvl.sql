SELECT * EXCLUDE (token0_symbol, token1_symbol) FROM pool_value
