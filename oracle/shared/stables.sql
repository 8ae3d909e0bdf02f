-- Fixed values: the stable-coin symbols.
SELECT unnest(['USDC', 'USDT', 'DAI', 'FEI', 'EURS']) AS symbol
