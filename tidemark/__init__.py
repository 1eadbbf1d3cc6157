"""Tidemark: medallion and star-schema analytics as plain PySpark jobs."""
