"""Transaction surveillance and corpus preparation on Spark."""
