SELECT p.block_id, if(coalesce(s.price_1_0 * (p.block_id % 4) BETWEEN p.price_lower_1_0 AND p.price_upper_1_0, false),
                      '_in_range_', '_out_of_range_') AS state
FROM positions p JOIN pool_stats s ON p.block_id = s.block_id
