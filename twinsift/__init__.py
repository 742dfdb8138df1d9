"""Near-duplicate media analytics on Spark."""
