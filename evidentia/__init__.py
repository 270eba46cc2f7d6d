"""Analytics over reported results and the conditions they were measured under, on Spark DataFrames."""
