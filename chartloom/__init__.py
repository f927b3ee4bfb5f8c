"""Document operations on Spark."""
