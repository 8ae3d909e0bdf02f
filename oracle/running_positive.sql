SELECT liquidity_provider, pool_address, pool_name, liquidity_adj, block_day FROM holdings
