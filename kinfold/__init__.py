"""Explainable entity matching on Spark DataFrames."""
