"""Photo-library curation and corpus preparation on Spark DataFrames."""
