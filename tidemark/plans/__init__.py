"""Domain queries and the registry of runnable ones."""
