"""Bill-of-materials and part-change analytics on Spark DataFrames."""
