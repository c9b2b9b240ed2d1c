"""Customer intelligence for an online store, expressed as Spark DataFrame jobs."""
