"""loamworks: evolving, source-backed tables and training-data preparation as Spark jobs."""
