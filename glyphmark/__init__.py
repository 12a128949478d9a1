"""Glyphmark: detection-and-reading evaluation on Spark DataFrames."""
