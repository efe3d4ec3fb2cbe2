"""Trials, time series and their statistics as Spark DataFrames."""
