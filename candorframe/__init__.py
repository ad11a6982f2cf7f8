"""Media evidence analytics as PySpark DataFrame operations."""
