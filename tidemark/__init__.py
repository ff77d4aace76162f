"""tidemark: signed multisets, change logs and training-data operators on Spark DataFrames."""
