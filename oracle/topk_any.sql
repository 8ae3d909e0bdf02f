WITH b AS (SELECT borrower AS address, CAST(sum(CAST(loan_amount_usd AS DECIMAL(38, 8))) AS DOUBLE) AS borrow_usd FROM borrows GROUP BY 1),
r AS (SELECT borrower AS address, CAST(sum(CAST(repayed_amount_usd AS DECIMAL(38, 8))) AS DOUBLE) AS repay_usd FROM repayments GROUP BY 1)
SELECT address, borrow_usd, repay_usd,
       row_number() OVER (ORDER BY borrow_usd DESC NULLS LAST, address) AS borrow_rank,
       row_number() OVER (ORDER BY repay_usd DESC NULLS LAST, address) AS repay_rank
FROM b FULL JOIN r USING (address)
QUALIFY borrow_rank <= 20 OR repay_rank <= 20
