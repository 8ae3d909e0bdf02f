SELECT supplied_symbol, count(*) AS n, sum(supplied_base_asset) AS amount FROM deposits
WHERE block_timestamp > TIMESTAMP '2001-08-01' - INTERVAL 6 MONTH AND block_timestamp < DATE '2001-08-02' GROUP BY 1
