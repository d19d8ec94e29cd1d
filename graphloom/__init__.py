"""graphloom: dependency-graph analytics on Spark DataFrames."""
