"""textweir: screening and statistics of text at scale, on Spark DataFrames."""
