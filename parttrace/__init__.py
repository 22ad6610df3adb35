"""Audit of train/test partitions by lineage, content and similarity, on Spark DataFrames."""
