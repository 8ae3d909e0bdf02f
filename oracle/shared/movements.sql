SELECT blk_date, liquidity_provider, pool_name, open_state, change_that_day,
       sum(open_liquidity) AS open_liquidity, sum(close_liquidity) AS close_liquidity,
       avg(open_price) AS open_price, avg(close_price) AS close_price
FROM (SELECT *, CASE
        WHEN open_state <> '_out_of_range_' OR open_liquidity <= 0 THEN 'Other'
        WHEN close_liquidity > 0 AND close_state = '_in_range_'
          THEN if(least(token_increases, token_decreases) > 0, 'Updated_range', 'Floated_into_range')
        WHEN close_liquidity > 0 THEN 'Still_out_of_range'
        WHEN close_state = '_out_of_range_' AND token_decreases > 0 THEN 'Reduced_exposure'
        ELSE 'Other' END AS change_that_day
      FROM responses)
GROUP BY 1, 2, 3, 4, 5
