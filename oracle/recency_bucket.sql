SELECT CASE WHEN block_timestamp >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY THEN 'last_30'
            WHEN block_timestamp >= TIMESTAMP '2001-08-01' - INTERVAL 60 DAY THEN '31_60'
            WHEN block_timestamp >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY THEN '61_90'
            WHEN block_timestamp >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY THEN '91_180'
            WHEN block_timestamp >= TIMESTAMP '2001-08-01' - INTERVAL 360 DAY THEN '181_360'
            WHEN block_timestamp IS NOT NULL THEN 'over_360' ELSE '_none_' END AS num_days_since,
       borrows_contract_symbol, sum(loan_amount_usd) AS loan_amount_usd, count(tx_id) AS num_txs
FROM borrows GROUP BY 1, 2
