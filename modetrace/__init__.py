"""modetrace: mobility analytics on Spark DataFrames."""
