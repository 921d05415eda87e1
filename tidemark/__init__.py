"""Deterministic analytics over price-like series, built on Spark DataFrames."""
