WITH closing AS (
  SELECT pool_address, CAST(block_timestamp AS DATE) AS block_day,
         ('0x' || fee_growth_global0_x128[1:32])::UHUGEINT AS upper, ('0x' || fee_growth_global0_x128[33:64])::UHUGEINT AS lower
  FROM pool_stats
  QUALIFY row_number() OVER (PARTITION BY pool_address, CAST(block_timestamp AS DATE) ORDER BY block_timestamp DESC, block_id DESC) = 1
), paired AS (
  SELECT *, lag(upper) OVER w AS upper0, lag(lower) OVER w AS lower0, 340282366920938463463374607431768211455::UHUGEINT AS most
  FROM closing WINDOW w AS (PARTITION BY pool_address ORDER BY block_day)
), halves AS (
  -- a - b is most XOR (b - a - 1) where b is the larger one, so no step leaves 128 bits
  SELECT pool_address, block_day, most, lower < lower0 AS borrows,
         CASE WHEN lower < lower0 THEN xor(most, lower0 - lower - 1::UHUGEINT) ELSE lower - lower0 END AS low,
         CASE WHEN upper < upper0 THEN xor(most, upper0 - upper - 1::UHUGEINT) ELSE upper - upper0 END AS high
  FROM paired
)
SELECT pool_address, block_day,
       CAST(CASE WHEN NOT borrows THEN high WHEN high = 0 THEN most ELSE high - 1::UHUGEINT END AS DOUBLE)
       + CAST(low AS DOUBLE) / 340282366920938463463374607431768211456.0::DOUBLE AS fee_growth
FROM halves
