"""Legal-text and training-data engine on Spark DataFrames."""
