WITH b AS (
  SELECT borrower AS who, borrows_contract_symbol AS sym, sum(loan_amount) AS amt, CAST(sum(CAST(loan_amount_usd AS DECIMAL(38, 8))) AS DOUBLE) AS usd
  FROM borrows WHERE block_timestamp >= DATE '2001-08-01' - 60 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
d AS (
  SELECT supplier AS who, supplied_symbol AS sym, sum(supplied_base_asset) AS amt, CAST(sum(CAST(supplied_base_asset_usd AS DECIMAL(38, 8))) AS DOUBLE) AS usd
  FROM deposits WHERE block_timestamp >= DATE '2001-08-01' - 60 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
ranked AS (
  SELECT who, sym, b.amt AS ba, b.usd AS bu, d.amt AS da, d.usd AS du,
         row_number() OVER (ORDER BY b.usd DESC NULLS LAST, who, sym) AS rb,
         row_number() OVER (ORDER BY d.usd DESC NULLS LAST, who, sym) AS rd
  FROM b FULL JOIN d USING (who, sym))
SELECT sym AS underlying_symbol, who AS symbol_address, rb AS borrow_amt_token_order, rd AS deposit_amt_token_order,
       if(rb <= 50, ba, NULL) AS borrow_amt_token, if(rb <= 50, bu, NULL) AS borrow_amt_usd,
       if(rd <= 50, da, NULL) AS deposit_amt_token, if(rd <= 50, du, NULL) AS deposit_amt_usd
FROM ranked WHERE least(rb, rd) <= 50
