"""Analytics over catalogue data, built from Spark DataFrames and SQL expressions."""
