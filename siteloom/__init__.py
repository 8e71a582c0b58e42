"""siteloom: website-archive analytics as Spark DataFrames."""
