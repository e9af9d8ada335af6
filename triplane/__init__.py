"""A Datalog and training-data engine that runs on Spark DataFrames."""
