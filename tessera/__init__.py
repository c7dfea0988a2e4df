"""tessera: catalog-style analytics on Spark DataFrames."""
