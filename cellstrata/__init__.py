"""Sorted, versioned cell stores as Spark DataFrames."""
