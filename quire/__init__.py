"""quire: prose analytics on Spark DataFrames."""
