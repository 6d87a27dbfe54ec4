"""Corpus linguistics on Spark DataFrames."""
