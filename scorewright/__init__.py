"""scorewright: evaluation analytics and training-data preparation on Spark DataFrames."""
