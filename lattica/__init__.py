"""Exploratory analytics on Spark: typed block graphs and a small dataflow language, compiled to lazy DataFrames."""
