"""Versioned, ordered key-value tables and corpus operators on Spark DataFrames."""
