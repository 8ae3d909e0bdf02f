WITH b AS (
  SELECT borrower AS who, borrows_contract_symbol AS sym, sum(loan_amount) AS amt, sum(CAST(loan_amount_usd AS DECIMAL(38, 8))) AS usd,
         count(DISTINCT tx_id) AS n
  FROM borrows WHERE block_timestamp >= DATE '2001-08-01' - 30 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
d AS (
  SELECT supplier AS who, supplied_symbol AS sym, sum(supplied_base_asset) AS amt, sum(CAST(supplied_base_asset_usd AS DECIMAL(38, 8))) AS usd,
         count(DISTINCT tx_id) AS n
  FROM deposits WHERE block_timestamp >= DATE '2001-08-01' - 30 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
p AS (
  SELECT borrower AS who, repay_contract_symbol AS sym, sum(repayed_amount) AS amt, sum(repayed_amount_usd) AS usd,
         count(DISTINCT tx_id) AS n
  FROM repayments WHERE block_timestamp >= DATE '2001-08-01' - 30 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
l AS (
  SELECT borrower AS who, liquidation_contract_symbol AS sym, sum(liquidation_amount) AS amt,
         sum(liquidation_amount_usd) AS usd, count(DISTINCT tx_id) AS n
  FROM liquidations WHERE block_timestamp >= DATE '2001-08-01' - 30 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
w AS (
  SELECT supplier AS who, recieved_contract_symbol AS sym, sum(recieved_amount) AS amt, sum(recieved_amount_usd) AS usd,
         count(DISTINCT tx_id) AS n
  FROM redemptions WHERE block_timestamp >= DATE '2001-08-01' - 30 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
m AS (
  SELECT who, sym, b.amt AS ba, b.usd AS bu, b.n AS bn, d.amt AS da, d.usd AS du, d.n AS dn
  FROM b FULL JOIN d USING (who, sym)),
top AS (
  SELECT who, sum(bu) AS tb, sum(du) AS td,
         row_number() OVER (ORDER BY sum(bu) DESC NULLS LAST, who) AS rb,
         row_number() OVER (ORDER BY sum(du) DESC NULLS LAST, who) AS rd
  FROM m GROUP BY who QUALIFY rb <= 20 OR rd <= 20)
SELECT who AS overall_address, sym AS underlying_symbol, ba AS borrow_amt_token, bu AS borrow_amt_usd,
       da AS deposit_amt_token, du AS deposit_amt_usd, bn AS num_borrows, dn AS num_deposits,
       p.amt AS token_repay_amount, p.usd AS loan_repay_amount_usd, l.amt AS token_liquidation_amount,
       l.usd AS loan_liquidation_amount_usd, w.amt AS token_redeem_amount, w.usd AS loan_redeem_amount_usd,
       p.n AS num_repay, l.n AS num_liquidations, w.n AS num_redemptions,
       bu - p.usd AS net_borrowing, du - w.usd AS net_deposits, who AS symbol_address,
       tb AS borrow_total_amt_usd, td AS deposit_total_amt_usd,
       rb AS borrow_amt_token_order, rd AS deposit_amt_token_order
FROM m LEFT JOIN p USING (who, sym) LEFT JOIN l USING (who, sym) LEFT JOIN w USING (who, sym) JOIN top USING (who)
