"""Lending-market and concentrated-liquidity analytics on Spark DataFrames."""
