"""Evidence retrieval over text as Spark jobs."""
