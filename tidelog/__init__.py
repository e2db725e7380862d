"""tidelog: change-stream analytics expressed as Spark DataFrames."""
