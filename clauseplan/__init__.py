"""A logic-rules analytics engine that plans straight into Spark DataFrames."""
