SELECT liquidity_provider, block_id, pool_name, liquidity_adjusted FROM positions
QUALIFY block_timestamp = min(block_timestamp) OVER (PARTITION BY liquidity_provider)
