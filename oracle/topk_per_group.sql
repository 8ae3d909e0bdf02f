SELECT supplied_symbol, tx_id, supplier, supplied_base_asset_usd, supplied_base_asset,
       row_number() OVER (PARTITION BY supplied_symbol
                          ORDER BY supplied_base_asset_usd DESC, tx_id, supplied_base_asset) AS rank
FROM deposits QUALIFY rank <= 10
