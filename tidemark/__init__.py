"""Market-data research and training-data preparation on Spark."""
