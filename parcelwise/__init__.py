"""Property-market analytics as Spark DataFrame jobs."""
