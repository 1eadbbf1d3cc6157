"""DataFrame-level operators built only from Spark's own relational ones."""
