"""Customer transaction behaviour features as Spark DataFrame jobs."""
