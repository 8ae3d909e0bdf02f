WITH b AS (
  SELECT CAST(block_timestamp AS DATE) AS day, borrows_contract_symbol AS sym, sum(loan_amount_usd) AS usd,
         count(DISTINCT borrower) AS who, count(DISTINCT tx_id) AS txs, count(tx_id) AS n
  FROM borrows WHERE block_timestamp >= DATE '2001-08-01' - 180 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
d AS (
  SELECT CAST(block_timestamp AS DATE) AS day, supplied_symbol AS sym, sum(supplied_base_asset_usd) AS usd,
         count(DISTINCT supplier) AS who, count(DISTINCT tx_id) AS txs, count(tx_id) AS n
  FROM deposits WHERE block_timestamp >= DATE '2001-08-01' - 180 AND block_timestamp < DATE '2001-08-02' GROUP BY 1, 2),
r AS (
  SELECT coalesce(b.day, d.day) AS day, coalesce(b.sym, d.sym) AS sym,
         sum(b.usd) OVER wb AS bu, sum(d.usd) OVER wd AS du, sum(b.txs) OVER wb AS bt, sum(d.txs) OVER wd AS dt,
         sum(b.n) OVER wb AS bn, sum(d.n) OVER wd AS dn, avg(b.who) OVER wb AS bw, avg(d.who) OVER wd AS dw
  FROM b FULL JOIN d ON b.day = d.day AND b.sym = d.sym
  WINDOW wb AS (PARTITION BY b.sym ORDER BY b.day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
         wd AS (PARTITION BY d.sym ORDER BY d.day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT day AS overall_block_day, sym AS underlying_symbol,
       bu AS borrows_usd_30day_rolling_sum, du AS deposits_usd_30day_rolling_sum,
       CAST(bt AS BIGINT) AS dist_num_borrows_30day_rolling_sum,
       CAST(dt AS BIGINT) AS dist_num_deposits_30day_rolling_sum,
       CAST(bn AS BIGINT) AS num_borrows_30day_rolling_sum, CAST(dn AS BIGINT) AS num_deposits_30day_rolling_sum,
       bw AS num_borrowers_30day_rolling_avg, dw AS num_depositors_30day_rolling_avg,
       bu / nullif(du, 0) AS borrowing_as_pct_of_deposits_usd_30day_rolling,
       bt / nullif(dt, 0) AS dist_num_of_borrows_as_pct_of_deposits_30day_rolling,
       bw / nullif(dw, 0) AS avg_num_borrowers_as_pct_of_depositors_30day_rolling,
       -bu AS neg_borrows_usd_30day_rolling_sum, CAST(-bt AS BIGINT) AS neg_dist_num_borrows_30day_rolling_sum,
       -bw AS neg_num_borrowers_30day_rolling_avg,
       du / nullif(dt, 0) AS avg_deposit_size_usd_30day_rolling, bu / nullif(bt, 0) AS avg_borrow_size_usd_30day_rolling
FROM r
