"""Bitemporal analytics on Spark DataFrames."""
