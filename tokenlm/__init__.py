"""Token streams and next-token statistics as Spark DataFrames."""
