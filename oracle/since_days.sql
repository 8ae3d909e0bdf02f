SELECT tx_id, borrower, loan_amount_usd FROM borrows
WHERE block_timestamp >= DATE '2001-08-01' - 180 AND block_timestamp < DATE '2001-08-02'
