"""Strandlake: long-sequence and interval analytics as plain Spark DataFrames."""
