"""Analytics for evidence retrieval and corpus data on PySpark: every operator takes DataFrames and returns a DataFrame."""
