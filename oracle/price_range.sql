SELECT * FROM price_span
