"""Demand-forecasting features, back-tests and scores on Spark DataFrames."""
