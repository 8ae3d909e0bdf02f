SELECT underlying_symbol, CAST(block_hour AS DATE) AS block_day,
       covar_pop(supply_apy, borrow_apy) / nullif(stddev_pop(supply_apy) * stddev_pop(borrow_apy), 0) AS corr_apys,
       covar_pop(reserves_token_amount, token_price)
         / nullif(stddev_pop(reserves_token_amount)
                  * stddev_pop(token_price) FILTER (reserves_token_amount IS NOT NULL), 0) AS corr_reserves
FROM market_stats GROUP BY 1, 2
