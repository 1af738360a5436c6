"""Block-sample analytics on PySpark DataFrames."""
