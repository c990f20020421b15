"""lexloom: source-code and corpus analytics on PySpark DataFrames."""
