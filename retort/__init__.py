"""retort: chemical-markup and training-data processing on Spark DataFrames."""
