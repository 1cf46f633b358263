"""Annotation analytics, weak supervision and corpus curation on Spark DataFrames."""
