"""Condensation and measurement of document collections on Spark DataFrames."""
