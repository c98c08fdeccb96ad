"""Granary: xBase-style table, sequence and scorecard operators on Spark DataFrames."""
