"""Labelled-array analytics for ensemble time series on Spark DataFrames."""
