"""Labelled short-text analytics on Spark DataFrames."""
