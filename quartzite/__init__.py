"""Quartzite: cluster analysis and inference on Spark DataFrames."""
