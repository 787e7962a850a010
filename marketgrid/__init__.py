"""Panel analytics for asset returns on Spark DataFrames."""
