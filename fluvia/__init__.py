"""Raster-series and risk analytics on Spark DataFrames."""
