"""Cost-aware query routing over retrieval results, on Spark DataFrames."""
