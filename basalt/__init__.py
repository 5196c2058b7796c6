"""Evidence retrieval and workspace analytics as Spark DataFrame jobs."""
