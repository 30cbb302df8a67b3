"""helixframe: sequence analytics on Spark DataFrames."""
