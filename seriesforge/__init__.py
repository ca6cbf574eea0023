"""Label-indexed metrics on Spark DataFrames."""
