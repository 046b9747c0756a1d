"""Media catalogues and training-data preparation on Spark."""
