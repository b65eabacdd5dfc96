"""textloom: text measurement and integrity checks on Spark DataFrames."""
