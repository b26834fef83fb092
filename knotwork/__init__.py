"""knotwork: named-graph analytics on Spark DataFrames."""
