"""A knowledge-base query engine on PySpark DataFrames."""
