"""Relation algebra, retrieval analytics and record processing on Spark DataFrames."""
