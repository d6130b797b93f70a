"""Document retrieval and text analytics as PySpark DataFrame jobs."""
