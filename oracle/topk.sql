SELECT borrower, sum(loan_amount_usd) AS borrowed, row_number() OVER (ORDER BY sum(loan_amount_usd) DESC, borrower) AS rank
FROM borrows GROUP BY 1 QUALIFY rank <= 25
