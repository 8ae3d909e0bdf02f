SELECT coalesce(b.who, r.who) AS address, coalesce(b.sym, r.sym) AS underlying_symbol,
       b.amt AS borrow_token, b.usd AS borrow_usd, r.amt AS repay_token, r.usd AS repay_usd
FROM (SELECT borrower AS who, borrows_contract_symbol AS sym, sum(loan_amount) AS amt, sum(loan_amount_usd) AS usd
      FROM borrows GROUP BY 1, 2) b
FULL JOIN (SELECT borrower AS who, repay_contract_symbol AS sym, sum(repayed_amount) AS amt,
                  sum(repayed_amount_usd) AS usd FROM repayments GROUP BY 1, 2) r
  ON b.who = r.who AND b.sym = r.sym
