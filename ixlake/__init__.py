"""ixlake: transaction-log indexing and analytics as PySpark DataFrame jobs."""
