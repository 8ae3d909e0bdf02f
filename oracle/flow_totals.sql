SELECT CAST(block_timestamp AS DATE) AS block_day, supplied_symbol AS underlying_symbol,
       sum(supplied_base_asset) AS token_amount, sum(supplied_base_asset_usd) AS amount_usd,
       count(DISTINCT supplier) AS num_users, count(DISTINCT tx_id) AS dist_num_txs, count(tx_id) AS num_txs
FROM deposits GROUP BY 1, 2
