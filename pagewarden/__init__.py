"""Page and text privacy analytics on Spark."""
