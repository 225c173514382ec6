"""Corpus-to-training-data engine built on Spark DataFrames."""
