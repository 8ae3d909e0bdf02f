SELECT * FROM edge_prices
