"""Models, result tables and checks, each a function from DataFrames to a DataFrame."""
